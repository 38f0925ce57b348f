"""Trains the line labeller: ``python -m linkloom.llm.train_blocks pages.parquet [pages]``.

No table says which lines are own content, so the training labels come from the pages whose markup tells. On a page with
a main heading, the element that holds the heading holds the content. Lines in it that are known as furniture from
outside such elements on other sites, author and date lines, advertisement labels and pointers to other articles are
not content. Pages without such an element, error pages and pages without content are furniture only if nothing but
known furniture stands on them, else they are not used.

So that the labeller does not lean on markup alone, each page is also shown with its wrappers taken off, with foreign
names on its elements, or with its heading as a plain block. So that it leans neither on the length of articles nor on their
words, pages are also shown cut to a few lines of their content, without furniture on either side or amid it, with their paragraphs as plain
blocks or parted into sentences, and with all their words unknown. The sample is bounded (``PAGES``).
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict

import numpy as np

from linkloom.llm.blocks import FORMS, PATHS, TITLE, WEIGHTS, WORDS, Features, Labeller, run_lstm
from linkloom.llm.pages import Line, host, line_key, text_lines

PAGES = 6000
RARE = 4  # times that a page without own content is shown, as there are few
UNKNOWN_WORDS, UNKNOWN_LINES = 0.1, 0.4  # shares made unknown in training, as other crawls have other words
FOREIGN = 0.12  # share of the pages with own content whose words are all made unknown, as of a language not seen
SHORT, BARE, PLAIN = 0.25, 0.25, 0.2  # shares of pages shown with few lines of content, without furniture before or after it, and with paragraphs as plain blocks
CLEAN, APART = 0.25, 0.35  # shares of pages shown without furniture amid the content, and with a line for each sentence
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
DIM_WORD, DIM_PATH, UNITS = 24, 16, 32
DATE = re.compile(r"^\d{1,2}(\.\d\d\.\d{4}|\.? \w+ \d{4})$|^\d{4}-\d\d-\d\d$")


def site_key(text: str, site: str) -> str:
    key = line_key(text)
    return key.replace(site, "§") if site else key


def container(lines: list[Line]) -> tuple[int, int, int] | None:
    """Number of the heading line, and first and last line of the element that holds it."""
    title = TITLE.split(lines[0].text)[0].lower() if lines else ""
    head = next((k for k, x in enumerate(lines) if any(p.split(".")[0] == "h1" for p in x.path)), None)
    if head is None:
        same = [k for k, x in enumerate(lines) if k and x.text.lower() == title and x.path and x.path[-1].split(".")[0] == "div" and x.linked == 0]
        if not same:
            return None
        head = same[0]
    deep = len(lines[head].path) - 1
    if deep <= 0 or lines[head].path[deep - 1].split(".")[0] in ("body", "html"):
        return None
    box = lines[head].ids[deep - 1]
    inside = [k for k, x in enumerate(lines) if box in x.ids]
    return head, inside[0], inside[-1]


class Teacher:
    """Knows furniture from all pages given."""

    def __init__(self, pages: list[tuple[str | None, list[Line]]]):
        outside, inside, heads, pointers, leads = defaultdict(set), defaultdict(set), defaultdict(set), Counter(), Counter()
        local, self.sites = defaultdict(set), []
        for n, (url, lines) in enumerate(pages):
            site = TITLE.split(lines[0].text)[-1].lower() if lines else ""
            self.sites.append(site)
            at, h = container(lines), (host(url) if url else None) or site
            if at and at[2] - at[0] <= 4:
                heads[site_key(lines[at[0]].text, site)].add(h)
            for k, x in enumerate(lines):
                key = site_key(x.text, site)
                if at and at[1] <= k <= at[2]:
                    if k != at[0] and x.path[-1].split(".")[0] not in ("td", "th", "li"):
                        inside[key].add(h)
                    if k - at[0] in (1, 2) and len(x.text.split()) <= 6:
                        leads[x.text.split()[0].lower()] += 1
                    if ":" in x.text[:40]:
                        pointers[key.partition(":")[0]] += 1
                elif at:
                    outside[key].add(h)
                    local[h, key].add(n)
        self.outside = {k for k, v in outside.items() if len(v) >= 2}
        self.short = {k for k, v in inside.items() if len(v) >= 10 and len(k) <= 40}
        self.errors = {k for k, v in heads.items() if len(v) >= 3}
        self.pointers = {k for k, v in pointers.items() if v >= 12 and k.count(" ") <= 3}
        self.leads = {k for k, v in leads.items() if v >= 60 and not k[0].isdigit()}
        self.local = {k for k, v in local.items() if len(v) >= 2}

    def is_error(self, lines: list[Line], at: tuple[int, int, int], site: str) -> bool:
        """A short page whose title names the site alone, or whose heading is that of short pages elsewhere."""
        head, _, last = at
        return last - head <= 4 and (len(TITLE.split(lines[0].text)) == 1 or site_key(lines[head].text, site) in self.errors)

    def labels(self, n: int, url: str | None, lines: list[Line]) -> np.ndarray | None:
        site, at = self.sites[n], container(lines)
        h = (host(url) if url else None) or site
        out = np.zeros(len(lines), np.float32)
        if at is None:
            known = [site_key(x.text, site) in self.outside or (h, site_key(x.text, site)) in self.local for x in lines[1:]]
            return out if all(known) else None
        head, first, last = at
        if self.is_error(lines, at, site):
            return out
        for k in range(head, last + 1):
            x = lines[k]
            key, cell = site_key(x.text, site), x.path[-1].split(".")[0] in ("td", "th", "li", "dt", "dd")
            if k == head:
                out[k] = 1
            elif (key in self.outside and not cell and key not in ("§",)) or (key in self.short and not cell) or (key.partition(":")[0] in self.pointers and ":" in key) or (k - head <= 3 and (DATE.match(x.text) or (x.text.split()[0].lower() in self.leads and len(x.text.split()) <= 8 and not x.text.endswith(".")))):
                out[k] = 0
            else:
                out[k] = 1
        return out


def disguise(lines: list[Line], at: tuple[int, int, int] | None, how: int, rng: np.random.Generator) -> list[Line]:
    """The same lines in other markup. how: 0 as is, 1 without names, 2 without wrappers, 3 wrappers as nameless divs, 4 misleading names."""
    if not how:
        return lines
    heading = rng.random() < 0.5
    names: dict[str, str] = {}
    lure = ["content-top", "sidebar-inner", "main-column", "post-content", "text", "entry", "menu", "content", "bottom", "col2", "main", "nav"]
    out = []
    for x in lines:
        path = []
        for k, p in enumerate(x.path):
            tag, _, name = p.partition(".")
            if tag in ("html", "body", "head", "title"):
                path.append(p)
                continue
            if tag in ("main", "nav", "aside", "footer", "article", "section", "header") and how in (1, 2, 3):
                tag, name = "div", "x"
            if tag == "h1" and heading and how != 1:
                tag = "div"
            wrapper = name != "" or (tag == "div" and k + 1 < len(x.path))
            if how == 2 and wrapper:
                continue
            if how == 4 and name:
                new = names.setdefault(p, str(rng.choice(lure)))
                path.append(f"{tag}.{new}")
            elif how == 1 and name:
                path.append(f"{tag}.{names.setdefault(p, f'{int(rng.integers(1 << 20)):05x}')}")
            else:
                path.append(tag)
        out.append(x._replace(path=tuple(path) or ("body",)))
    return out


def shortened(lines: list[Line], at: tuple[int, int, int] | None, y: np.ndarray, rng: np.random.Generator, short: float = SHORT, foreign: float = FOREIGN) -> tuple[list[Line], tuple[int, int, int] | None, np.ndarray, bool]:
    """The page with fewer lines of content or of furniture, a line for each sentence, or plain blocks for paragraphs; its labels; and whether its
    words are to be unknown, which goes without furniture amid the content, as only words tell it there. Pages without own content stay as they are.
    """
    if at is None or y[at[0] :].sum() < 3:
        return lines, at, y, False
    head, first, last = at
    strange = bool(rng.random() < foreign)
    keep = np.ones(len(lines), bool)
    if rng.random() < short:
        own = np.nonzero(y > 0.5)[0]
        own = own[own > head]
        some = own[(begin := int(rng.integers(len(own) - 1))) : begin + int(rng.integers(2, 9))]
        keep[head + 1 : last + 1] &= y[head + 1 : last + 1] < 0.5
        keep[some] = True
    if strange or rng.random() < CLEAN:
        keep[first : last + 1] &= y[first : last + 1] > 0.5
    for side in (slice(1, first), slice(last + 1, len(lines))):
        if rng.random() < BARE / 2:
            keep[side] = False
    if rng.random() < PLAIN:
        lines = [x._replace(path=(*x.path[:-1], "div")) if x.path and x.path[-1] == "p" else x for x in lines]
    apart = rng.random() < APART
    out, label, place = [], [], np.zeros(len(lines) + 1, int)
    for k, x in enumerate(lines):
        place[k] = len(out)
        if keep[k]:
            pieces = SENTENCE.split(x.text) if apart and y[k] > 0.5 and k > head else [x.text]
            out += [x._replace(text=t) for t in pieces if t]
            label += [y[k]] * sum(map(bool, pieces))
    place[len(lines)] = len(out)
    return out, (int(place[head]), int(place[first]), int(place[last + 1]) - 1), np.array(label, np.float32), strange


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = DIM_WORD + DIM_PATH + FORMS
    draw = lambda *s, by=None: (rng.standard_normal(s) * (by or 1 / np.sqrt(s[0]))).astype(np.float32)
    w = {"words": draw(WORDS, DIM_WORD, by=0.3), "paths": draw(PATHS, DIM_PATH, by=0.3), "by": np.zeros(1, np.float32), "yx": draw(wide, 1)}
    for way in "fb":
        w |= {"w" + way: draw(wide, 4 * UNITS), "u" + way: draw(UNITS, 4 * UNITS), "b" + way: np.zeros(4 * UNITS, np.float32), "y" + way: draw(UNITS, 1)}
        w["b" + way][UNITS : 2 * UNITS] = 1
    return w


def gradients(w: dict[str, np.ndarray], pages: list[list[Line]], labels: list[np.ndarray], rng: np.random.Generator | None = None, strange: list[bool] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch, by backpropagation through both directions. With ``rng`` some words, and more whole lines, are made unknown, and all of the pages in ``strange``."""
    f = Features(pages)
    if rng is not None:
        unknown = rng.random(len(f.words)) < UNKNOWN_WORDS
        unknown[f.wat] = rng.random(len(f.wat)) < UNKNOWN_LINES
        of_line = np.repeat(np.array(strange or [False] * len(pages)), f.sizes)
        unknown |= np.repeat(of_line, np.diff(np.append(f.wat, len(f.words))))
        f.words[unknown] = rng.integers(0, WORDS, unknown.sum())
    x = Labeller(w).inputs(f)
    y = np.concatenate(labels)[:, None]
    steps, rows, n = int(f.sizes.max()), len(pages), len(x)
    row = np.repeat(np.arange(rows), f.sizes)
    ahead = np.arange(n) - np.repeat(np.cumsum(f.sizes) - f.sizes, f.sizes)
    back = np.repeat(f.sizes, f.sizes) - 1 - ahead
    live = np.zeros((steps, rows, 1), np.float32)
    live[ahead, row] = 1
    total, kept, states = w["by"] + x @ w["yx"], {}, {}
    for way, at in (("f", ahead), ("b", back)):
        z = np.zeros((steps, rows, 4 * UNITS), np.float32)
        z[at, row] = x @ w["w" + way] + w["b" + way]
        kept[way] = []
        states[way] = run_lstm(z, live, w["u" + way], kept[way])
        total = total + states[way][at, row] @ w["y" + way]
    p = 0.5 * np.tanh(0.5 * total) + 0.5
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    d = (p - y) / n
    g = {"by": d.sum(0), "yx": x.T @ d}
    dx = d @ w["yx"].T
    k = UNITS
    for way, at in (("f", ahead), ("b", back)):
        u = w["u" + way]
        g["y" + way] = states[way][at, row].T @ d
        dh_out = np.zeros((steps, rows, k), np.float32)
        dh_out[at, row] = d @ w["y" + way].T
        da_all = np.zeros((steps, rows, 4 * k), np.float32)
        dh, dc, du = np.zeros((rows, k), np.float32), np.zeros((rows, k), np.float32), np.zeros_like(u)
        for t in range(steps - 1, -1, -1):
            h0, c0, i, fg, o, gg, tc = kept[way][t]
            dht = (dh_out[t] + dh) * live[t]
            dct = (dc + dht * o * (1 - tc * tc)) * live[t]
            da = np.concatenate([dct * gg * i * (1 - i), dct * c0 * fg * (1 - fg), dht * tc * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
            da_all[t] = da
            du += h0.T @ da
            dh, dc = da @ u.T, dct * fg
        flat = da_all[at, row]
        g["u" + way], g["w" + way], g["b" + way] = du, x.T @ flat, flat.sum(0)
        dx += flat @ w["w" + way].T
    for name, ids, begin, part in (("words", f.words, f.wat, dx[:, :DIM_WORD]), ("paths", f.paths, f.pat, dx[:, DIM_WORD : DIM_WORD + DIM_PATH])):
        count = np.diff(np.append(begin, len(ids)))
        each = np.repeat(part / count[:, None], count, axis=0)
        order = np.argsort(ids, kind="stable")
        own, first = np.unique(ids[order], return_index=True)
        full = np.zeros_like(w[name])
        full[own] = np.add.reduceat(each[order], first, axis=0)
        g[name] = full
    return loss, g


def train(pages: list[tuple[str | None, list[Line]]], epochs: int = 30, batch: int = 48, rate: float = 4e-3, seed: int = 7, hold: int = 10, say=print) -> dict[str, np.ndarray]:
    """Weights after some epochs. Every tenth host is held out, and accuracy on it is said."""
    teacher, rng = Teacher(pages), np.random.default_rng(seed)
    own, held = [], []
    for n, (url, lines) in enumerate(pages):
        if lines and (y := teacher.labels(n, url, lines)) is not None:
            h = (host(url) if url else None) or ""
            to = held if sum(map(ord, h)) % hold == 0 else own
            to += [(lines, container(lines), y)] * (1 if to is held or y.any() else RARE)
    say(f"{len(own)} pages to train on, {len(held)} held out, of {len(pages)}")
    w = start(seed)
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, total = 0, epochs * (len(own) // batch + 1)
    for epoch in range(epochs):
        losses = []
        order = rng.permutation(len(own))
        groups = [order[i : i + batch * 8] for i in range(0, len(order), batch * 8)]
        for group in groups:
            group = sorted(group, key=lambda k: len(own[k][0]))
            for i in range(0, len(group), batch):
                some = [own[k] for k in group[i : i + batch]]
                some = [shortened(*x, rng) for x in some]
                views = [disguise(x, at, int(rng.choice(5, p=[0.3, 0.15, 0.25, 0.15, 0.15])), rng) for x, at, _, _ in some]
                loss, g = gradients(w, views, [y for _, _, y, _ in some], rng, [odd for *_, odd in some])
                step += 1
                now = rate * min(1, step / 50) * (0.5 + 0.5 * np.cos(np.pi * min(1, step / total)))
                for k in w:
                    a, b = m[k]
                    grad = np.clip(g[k], -1, 1)
                    a += 0.1 * (grad - a)
                    b += 0.005 * (grad * grad - b)
                    w[k] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.995**step)) + 1e-7)
                losses.append(loss)
        say(f"epoch {epoch + 1}: loss {np.mean(losses):.4f}")
    for how in range(5):
        views = [disguise(x, at, how, rng) for x, at, _ in held]
        wrong = [int(((p > 0.5) != (y > 0.5)).sum()) for p, (_, _, y) in zip(Labeller(w).chances(views), held, strict=True)]
        say(f"held-out hosts, disguise {how}: {1 - sum(wrong) / max(1, sum(len(x) for x, _, _ in held)):.4f} of the lines right, {wrong.count(0) / max(1, len(held)):.3f} of the pages throughout")
    cut = [shortened(*x, rng, short=1.0, foreign=0)[:3] for x in held]
    wrong = [int(((p > 0.5) != (y > 0.5)).sum()) for p, (_, _, y) in zip(Labeller(w).chances([x for x, _, _ in cut]), cut, strict=True)]
    say(f"held-out hosts, cut short: {1 - sum(wrong) / max(1, sum(len(x) for x, _, _ in cut)):.4f} of the lines right, {wrong.count(0) / max(1, len(cut)):.3f} of the pages throughout")
    return w


def main(path: str, count: int = PAGES) -> None:
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["page_id", "url", "html"]).slice(0, count).to_pylist()
    weights = train([(r["url"], text_lines(r["html"])) for r in rows if r["html"]])
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in weights.items()})


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
