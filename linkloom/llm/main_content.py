"""Main body of pages, and pages stuffed with keywords or links.

Both come from one reading of each page: its lines, their labels by the recurrent labeller (``blocks``), and the measures of
its own content (``stuffing``). No shuffle: a page is read where it is stored, and only numbers of lines leave.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical
from linkloom.llm.arrow import map_rows, spread
from linkloom.llm.blocks import labeller
from linkloom.llm.pages import text_lines
from linkloom.llm.stuffing import is_stuffed, profile, verdict

CHANCE = 0.5
WORD = re.compile(r"[^\W_]+")
MEASURES = ("words", "bare_share", "link_share", "plain_share", "near_share", "regularity", "autocorrelation", "distinct_share", "all_recurrences", "all_near_share", "all_regularity", "all_autocorrelation")


def read_pages(pages: list[str | None], chance: float = CHANCE, every: bool = False) -> list[tuple[list, list[int], dict[str, float], bool]]:
    """Of each page its lines, the numbers (from 1) of its own lines, the measures of these, and whether it is stuffed."""
    lines = [text_lines(p) for p in pages]
    out = []
    for own, p in zip(lines, labeller().chances(lines), strict=True):
        numbers = (np.nonzero(p > chance)[0] + 1).tolist()
        measured = profile([own[k - 1] for k in numbers], every)
        out.append((own, numbers, measured, is_stuffed(measured)))
    return out


def main_lines(pages: DataFrame, key: str = "page_id", html: str = "html", chance: float = CHANCE) -> DataFrame:
    """One row (key, line_no) for each line of a page's main body.

    Null and empty pages, error pages, pages that show only a notice and stuffed pages have none. Each row of the input
    is read for itself: repeated rows give repeated rows, a null key is kept. Other columns are not read.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"key": x["key"], "lines": [[] if bad else numbers for _, numbers, _, bad in read_pages(x["html"], chance)]}

    kind = dict(pages.dtypes)[key]
    rows = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html")))
    return map_rows(rows, run, f"key {kind}, lines array<int>").select(F.col("key").alias(key), F.explode("lines").alias("line_no"))


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", chance: float = CHANCE) -> DataFrame:
    """One row (key, body) for each page: the lines of its main body, joined by line breaks; empty where it has none."""

    def run(x: dict[str, list]) -> dict[str, list]:
        return {"key": x["key"], "body": ["" if bad else "\n".join(own[k - 1].text for k in numbers) for own, numbers, _, bad in read_pages(x["html"], chance)]}

    kind = dict(pages.dtypes)[key]
    rows = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html")))
    return map_rows(rows, run, f"key {kind}, body string").withColumnRenamed("key", key)


def stuffing_measures(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each page: the measures of its own content and ``stuffed``. Null and empty pages have zeros and false."""

    def run(x: dict[str, list]) -> dict[str, list]:
        read = read_pages(x["html"], every=True)
        return {"key": x["key"], "stuffed": [bad for *_, bad in read]} | {k: [m[k] for _, _, m, _ in read] for k in MEASURES}

    kind = dict(pages.dtypes)[key]
    rows = spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html")))
    return map_rows(rows, run, f"key {kind}, stuffed boolean, " + ", ".join(f"{k} double" for k in MEASURES)).withColumnRenamed("key", key)


def link_counts(links: DataFrame, stored: DataFrame) -> DataFrame:
    """(u, outlinks) by canonical address: rows of ``links`` (src), or the stored outdegree where that is more. Null addresses drop out."""
    own = links.where("src is not null").groupBy(canonical(F.col("src")).alias("u")).agg(F.count("*").alias("k"))
    told = stored.where("url is not null").groupBy(canonical(F.col("url")).alias("u")).agg(F.max("outdegree").alias("k"))
    return own.unionByName(told).groupBy("u").agg(F.max("k").alias("outlinks"))


def stuffed_pages(pages: DataFrame, links: DataFrame | None = None, stored: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Keys of the stuffed pages. Null and empty pages are none; each row is read for itself.

    Where the sequence of a page's words tells nothing, its links decide: those of ``links`` (src) or the ``stored`` (url, outdegree), less those in the site's
    furniture. Only such pages, and those found by their words, are joined with the link counts.
    """
    kind = dict(pages.dtypes)[key]
    rows = spread(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")))

    def run(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("key", "url", "least")}
        for k, u, (lines, numbers, m, bad) in zip(x["key"], x["url"], read_pages(x["html"]), strict=True):
            if bad or verdict(m) is None and m["words"] >= 12 and u:
                own = set(numbers)
                out["key"].append(k)
                out["url"].append(u)
                out["least"].append(None if bad else m["words"] * m["bare_share"] / 2 + sum(line.linked > 0 for n, line in enumerate(lines, 1) if n not in own))
        return out

    found = map_rows(rows, run, f"key {kind}, url string, least double")
    if links is None or stored is None:
        return found.where("least is null").select(F.col("key").alias(key))
    met = found.withColumn("u", canonical(F.col("url"))).join(link_counts(links, stored), "u", "left")
    return met.where("least is null or outlinks >= least").select(F.col("key").alias(key))
