"""Keyword-stuffed, tagged and link-list pages, told in any language without word lists.

Of the words of a page's own content, those in sentences are told from those that stand bare. A sentence ends in a mark, has four words or
more, is not cut into short pieces by commas and other separators, and does not repeat its own words; in scripts without blanks
between words a long piece is one without a mark. Bare words are links, tags, places after a term, or search words in a row. Bare words
count as stuffing where the term sequence shows it: terms that recur at short or regular gaps, positions that agree with those a
fixed lag before them (autocorrelation over a window of lags), long runs of distinct names of which none recurs as function words do,
or links. Where the sequence shows nothing, the page's links in the link table and its stored outdegree decide.

Recurrence is also measured over all words of the own content, in sentences or not, and decides by itself: stuffing can be written in
sentences. Function words make some words of any text recur; the limits leave room for them in every language.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from linkloom.llm.pages import Line, line_key

WORD = re.compile(r"[^\W_]+")
# letters, digits and the marks that scripts set at letters
MARKED = re.compile("[\\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0670\u0900-\u0903\u093a-\u0963\u0981-\u0983\u09bc-\u09e3\u0a01-\u0a4d\u0abc-\u0acd\u0b01-\u0b56\u0b82-\u0bcd\u0c00-\u0c56\u0cbc-\u0cd6\u0d00-\u0d57\u0e31-\u0e4e\u0eb1-\u0ecd\u102b-\u103e\u17b4-\u17d3\u200c\u200d]+")
PART = re.compile(r"(?<=[.!?…।։؟。！？])[\"”»’')」』]*\s*(?=\S)|\s[–—|]\s")
END = re.compile(r"[.!?…।։؟。！？][\"”»’')」』]*$")
SEPARATOR = re.compile(r"[,;:|/#•·()\[\]،、，；+*=<>]|\s[-–—]\s")
# letters of scripts that set no blanks between words; two count as a word
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
LAGS = 64
# Shares of all words that recur within LAGS. On the pages of the sample tables that are no cases they are 0.46 at most, the autocorrelation 0.27 at most, the bare share 0.30 at most.
SOME, MOST = 0.5, 0.65
LONG_RUN = 6  # words of a bare piece from which it may be prose without a mark


def gaps(terms: np.ndarray) -> tuple[float, float]:
    """Share of positions whose term stood at most LAGS positions before, and how regular those gaps are (1: all alike)."""
    if len(terms) < 2:
        return 0.0, 0.0
    order = np.argsort(terms, kind="stable")
    gap = np.diff(order)[terms[order][1:] == terms[order][:-1]]
    near = gap[gap <= LAGS]
    if not len(near):
        return 0.0, 0.0
    return len(near) / len(terms), float(1 / (1 + near.std() / near.mean()))


def autocorrelation(terms: np.ndarray) -> float:
    """Largest share of positions that agree with the position a lag before, over lags 1 to LAGS, above chance."""
    n = len(terms)
    if n < 8:
        return 0.0
    share = np.unique(terms, return_counts=True)[1] / n
    chance = float((share * share).sum())
    return max(float((terms[lag:] == terms[:-lag]).mean()) for lag in range(1, min(LAGS, n // 2) + 1)) - chance


def words_of(piece: str) -> list[str]:
    """The words of a piece in lower case."""
    return (WORD if piece.isascii() else MARKED).findall(piece.lower())


def numbered(words: Sequence[str]) -> np.ndarray:
    number: dict[str, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)


def is_sentence(piece: str, words: list[str]) -> tuple[int, bool]:
    """Number of words of a piece, and whether it is a sentence. ``words``: its runs of letters and digits, in lower case."""
    unspaced = 0 if piece.isascii() else len(UNSPACED.findall(piece))
    n = max(len(words), unspaced // 2)
    if n < 4:
        return n, False
    if not END.search(piece) and (unspaced < 16 or 6 * len(words) > unspaced):
        return n, False
    if n < 2.5 * (1 + len(SEPARATOR.findall(piece))):
        return n, False
    return n, len(words) < 8 or len(set(words)) >= 0.55 * len(words)


def repeats_itself(words: list[str]) -> bool:
    """Do words of at least the mean length recur within a piece? Those of function are shorter in every language."""
    mean = sum(map(len, words)) / max(1, len(words))
    long = [w for w in words if len(w) >= mean]
    return len(long) - len(set(long)) > 0.12 * len(words)


def content_terms(pieces: Sequence[tuple[str, list[str]]]) -> np.ndarray:
    """All words but numbers, as numbers by word. A piece that comes back, but for its digits, counts once, unless it repeats words itself."""
    seen: set[str] = set()
    out: list[str] = []
    for piece, words in pieces:
        piece = line_key(piece)
        if piece not in seen or repeats_itself(words):
            out += [w for w in words if not w.isdigit()]
            seen.add(piece)
    return numbered(out)


def profile(own: Sequence[Line], every: bool = True) -> dict[str, float]:
    """Measures of the own content of a page; its heading, the first line, is left out. Without words all are 0.

    Unless ``every`` is set, the measures of the bare sequence are left out where half of the words or more stand in sentences, and those
    of all words where few recur, as they can't change the outcome there.
    """
    bare: list[str] = []
    pieces: list[tuple[str, list[str]]] = []
    total = words_bare = words_linked = words_plain = 0
    for line in own[1:]:
        linked = line.linked >= 0.8
        for piece in PART.split(line.text):
            words = words_of(piece)
            if not words:
                continue
            pieces.append((piece, words))
            n, sentence = is_sentence(piece, words)
            total += n
            if linked or not sentence:
                words_bare += n
                bare += words
                if linked:
                    words_linked += n
                elif n >= LONG_RUN and not SEPARATOR.search(piece) and not any(map(str.isdigit, piece)) and not END.search(piece) and not any(w.isupper() and len(w) > 3 for w in piece.split()):
                    words_plain += n
    if not every and words_bare <= 0.5 * total:
        bare = []
    terms = numbered(bare)
    near, regular = gaps(terms)
    said = [w for _, words in pieces for w in words]
    # what recurs at any distance bounds what recurs near
    content = content_terms(pieces) if every or len(said) - len(set(said)) > SOME * len(said) else numbered(())
    all_near, all_regular = gaps(content)
    return {
        "words": float(total), "bare_share": words_bare / max(1, total), "link_share": words_linked / max(1, words_bare),
        "plain_share": words_plain / max(1, words_bare), "near_share": near, "regularity": regular,
        "autocorrelation": autocorrelation(terms), "distinct_share": len(set(bare)) / max(1, len(bare)),
        "all_recurrences": float(round(all_near * len(content))), "all_near_share": all_near, "all_regularity": all_regular,
        "all_autocorrelation": autocorrelation(content) if every or all_near > SOME else 0.0,
    }


def verdict(p: dict[str, float]) -> bool | None:
    """Is the page stuffed? None where its words stand bare, but their sequence tells nothing.

    All words recurrent, or many of them so and regularly; or more than half of the words bare, and their sequence that of stuffing: recurrent at
    near or regular gaps, distinct names in a row, or links. Names in a row tell nothing in fewer than 12 words, and long bare pieces without separators may be prose
    without marks, in which some words recur.
    """
    often = p["all_recurrences"] >= 6
    if often and (p["all_near_share"] > MOST or p["all_near_share"] > SOME and (p["all_regularity"] > 0.8 or p["all_autocorrelation"] > 0.6)):
        return True
    if p["bare_share"] <= 0.5:
        return False
    if p["link_share"] > 0.5:
        return True
    recurrent = p["near_share"] > SOME or p["near_share"] > 0.25 and p["regularity"] > 0.8 or p["autocorrelation"] > 0.12
    if recurrent:
        return True
    if p["words"] < 12 or p["plain_share"] > 0.5:
        return None
    return True


def is_stuffed(p: dict[str, float]) -> bool:
    """By the words alone; the links of pages whose words tell nothing are asked in ``main_content.stuffed_pages``."""
    return verdict(p) is True
