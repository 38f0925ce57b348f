"""Recurrent labeller of page lines.

A bidirectional LSTM in numpy reads the lines of a page in order. Each line is a vector of three parts: the mean of
trained vectors of its hashed words, the mean of trained vectors of its hashed markup path, and a few measures of its
form. The states of both directions decide whether the line is the page's own content; as they have read the whole page,
the same words can count in one place and not in another. Pages are labelled whole, however long.

The weights beside this file come from ``train_blocks.py``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np

from linkloom.llm.pages import Line, line_key

WORDS, PATHS, FORMS = 4096, 512, 16
WEIGHTS = Path(__file__).with_name("blocks.npz")
WORD = re.compile(r"[^\W\d_]+|0|[|›»©:–—#!?.,]|\n")
TITLE = re.compile(r" [–|-] ")
ENDS = frozenset(".!?…\"”»")
VOLUME = 16384  # lines, with the filling of shorter pages, that run together


@lru_cache(1 << 17)
def word_id(word: str) -> int:
    """-1 for a line break."""
    return -1 if word == "\n" else crc32(word.encode("utf-8", "surrogatepass")) % WORDS


@lru_cache(1 << 14)
def path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    """Hashed features of a path: outer and inner elements with and without their names, and each tag in between."""
    inner = [p for p in path if p not in ("html", "body")]
    tags = [p.split(".")[0] for p in inner]
    marks = {"depth" + str(min(len(inner), 6)), "in:" + "/".join(tags[-1:]), "in2:" + "/".join(tags[-2:]), "out:" + "/".join(tags[:1])}
    marks |= {"has:" + t for t in tags}
    for p in inner:
        name = p.partition(".")[2].strip().lower()
        marks |= {"name:" + w for w in re.split(r"[\W_]+", name) if w}
    if inner:
        marks.add("top:" + inner[0].lower())
    return tuple(sorted(crc32(m.encode()) % PATHS for m in marks))


class Features:
    """Lines of some pages as flat arrays: ``words`` and ``paths`` with the begin of each line, and ``forms``, measures that no word tells."""

    def __init__(self, pages: Sequence[Sequence[Line]], of: int | None = None, first: int = 0, head: Sequence[Line] | None = None):
        """``of``, ``first``, ``head``: of a piece of one page, the page's number of lines, the piece's place, and the lines before it (the page's first, and the last one before)."""
        words: list[int] = []
        wat: list[int] = []
        paths: list[int] = []
        pat: list[int] = []
        raw: list[tuple] = []
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        find, hashed = WORD.findall, word_id
        for page in pages:
            if not page:
                continue
            # a line break begins each line, and gives its place to the hash of the whole line, as a line can be known as such
            text = line_key("\n".join([line.text for line in page]))
            ids = [hashed(w) for w in find("\n" + text)]
            begins = [k for k, i in enumerate(ids) if i < 0]
            for k, key in zip(begins, text.split("\n"), strict=True):
                ids[k] = crc32(b"=" + key.encode("utf-8", "surrogatepass")) % WORDS
            done = len(words)
            wat += [done + k for k in begins]
            words += ids
            path = head[-1].path if head else None
            top = head[0] if head else page[0]
            title = TITLE.split(top.text)[0].lower() if top.path[-1:] == ("title",) else None
            for line in page:
                s, own = line.text, line.path
                pat.append(len(paths))
                paths += path_ids(own)
                n = len(s)
                raw.append((n, s.count(" ") + 1, sum(map(str.isdigit, s)) if n < 60 else 0, line.linked, s[-1] in ENDS, s[0].islower(), s.isupper(), s.count(","), path == own, s.count("|") + s.count("›"), path is not None and s.lower() == title, sum([w[0].isupper() for w in s.split(" ")]) if n < 60 else 0))
                path = own
        self.words, self.wat, self.paths, self.pat = (np.array(x, dtype=np.int64) for x in (words, wat, paths, pat))
        n, many, digits, linked, ends, low, up, commas, same, bars, titled, capitals = np.array(raw, dtype=np.float64).reshape(-1, 12).T
        at = first + np.arange(len(n)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        of = np.full(len(n), float(of)) if of else np.repeat(self.sizes, self.sizes).astype(np.float64)
        self.forms = np.stack([
            np.minimum(n, 600) / 200, np.minimum(many, 80) / 20, digits / n, linked, ends, low, up, at / of, np.minimum(at, 30) / 30,
            np.minimum(of - at, 30) / 30, commas / many, same, np.minimum(bars, 5) / 2, titled, capitals / many, np.ones(len(n)),
        ], axis=1).astype(np.float32)


    @classmethod
    def pieces(cls, page: Sequence[Line], size: int) -> Iterator[Features]:
        """Of one page, piece by piece; together the same measures as of the whole."""
        for k in range(0, len(page), size):
            yield cls([page[k : k + size]], len(page), k, (page[0], page[k - 1]) if k else None)


def _means(table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(at, len(ids))).astype(np.float32)
    return np.add.reduceat(table[ids], at, axis=0) / n[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_lstm(z: np.ndarray, live: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction. z: (steps, rows, 4 x units), inputs already weighted; live: (steps, rows, 1), 0 after a page's end."""
    steps, rows, wide = z.shape
    k = wide // 4
    h, c = np.zeros((rows, k), np.float32), np.zeros((rows, k), np.float32)
    out = np.empty((steps, rows, k), np.float32)
    for t in range(steps):
        a = z[t] + h @ u
        gates, g = _sigmoid(a[:, : 3 * k]), np.tanh(a[:, 3 * k :])
        i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        old = c
        c = (f * c + i * g) * live[t]
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, old, i, f, o, g, tc))
        h = o * tc * live[t]
        out[t] = h
    return out


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}

    def inputs(self, f: Features) -> np.ndarray:
        w = self.w
        return np.concatenate([_means(w["words"], f.words, f.wat), _means(w["paths"], f.paths, f.pat), f.forms], axis=1)

    def chances(self, pages: Sequence[Sequence[Line]], volume: int = VOLUME) -> list[np.ndarray]:
        """Of each page, the chance of each line to be own content.

        Pages of like length run together, as many as stay under ``volume`` lines with the filling; a longer page runs alone, its lines
        measured piece by piece. No page is cut.
        """
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - begin) <= volume:
                end += 1
            some = order[begin:end]
            f = [Features([pages[k] for k in some])] if end > begin + 1 else Features.pieces(pages[some[0]], volume)
            for k, piece in zip(some, self._chances(f), strict=True):
                out[k] = piece
            begin = end
        return out

    def _chances(self, parts: Sequence[Features] | Iterator[Features]) -> list[np.ndarray]:
        """``parts``: pages in one piece, or the pieces of one page."""
        w = self.w
        sizes, bases, ahead_z, back_z = [], [], [], []
        for f in parts:
            x = self.inputs(f)
            sizes.append(f.sizes)
            bases.append((x @ w["yx"] + w["by"])[:, 0])
            ahead_z.append(x @ w["wf"] + w["bf"])
            back_z.append(x @ w["wb"] + w["bb"])
        size = sizes[0] if len(sizes) == 1 else np.array([sum(int(s[0]) for s in sizes)])
        total = np.concatenate(bases)
        steps, rows = int(size.max()), len(size)
        row = np.repeat(np.arange(rows), size)
        ahead = np.arange(len(total)) - np.repeat(np.cumsum(size) - size, size)
        back = np.repeat(size, size) - 1 - ahead
        live = np.zeros((steps, rows, 1), np.float32)
        live[ahead, row] = 1
        for way, at, part in (("f", ahead, ahead_z), ("b", back, back_z)):
            z = np.zeros((steps, rows, w["u" + way].shape[1]), np.float32)
            z[at, row] = np.concatenate(part)
            part.clear()
            total = total + (run_lstm(z, live, w["u" + way])[at, row] @ w["y" + way])[:, 0]
            del z
        return np.split(_sigmoid(total), np.cumsum(size)[:-1])


@lru_cache(1)
def labeller() -> Labeller:
    """The trained labeller; read once in a process."""
    with np.load(WEIGHTS) as z:
        return Labeller({k: z[k] for k in z.files})
