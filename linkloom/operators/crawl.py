"""Crawling: the closure of admitted links from seeds, over a pluggable fetcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import links as lk
from linkloom.session import written

Fetcher = Callable[[DataFrame], DataFrame]


def crawl(seeds: DataFrame, fetch: Fetcher, rules: DataFrame, known_invalid: DataFrame, match: str = "base_of", deepest: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visited(url, depth), edges(src, dst), failed(url)).

    From the seeds, level by level: fetch, take the links inside the page's site, admit them, and go on with those not
    yet seen, until there is none, or to the depth ``deepest`` where it is given. Each address is fetched once. A failed fetch (null html) gives no edge and no page. An edge is one link
    occurrence whose target was fetched. Seeds are not held against the rules. ``fetch`` maps (url) to (url, html).
    """
    frontier = written(seeds.select("url").where("url is not null").distinct())
    seen, visited, links, failed, depth = frontier, None, None, None, 0
    while (deepest is None or depth <= deepest) and not frontier.isEmpty():
        got = written(fetch(frontier))
        good = got.where("html is not null").select("url", F.lit(depth).alias("depth"))
        bad = got.where("html is null").select("url")
        visited, failed = (good, bad) if visited is None else (visited.unionByName(good), failed.unionByName(bad))
        found = lk.in_domain(lk.resolved(got.where("html is not null").select("url", F.col("url").alias("page_url"), "html"), "url", "page_url"))
        new = written(lk.admitted(found.select(F.col("page").alias("src"), F.col("target").alias("dst")), known_invalid, rules, match))
        links = new if links is None else links.unionByName(new)
        frontier = written(new.select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti"))
        seen = written(seen.unionByName(frontier)) if depth % 8 == 7 else seen.unionByName(frontier)
        depth += 1
    if visited is None:
        empty = seeds.select("url").limit(0)
        return empty.withColumn("depth", F.lit(0)), empty.select(F.col("url").alias("src"), F.col("url").alias("dst")), empty
    edges = links.join(visited.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")
    return visited, edges, failed


def closure_of_snapshot(seeds: DataFrame, pages: DataFrame, rules: DataFrame, known_invalid: DataFrame, match: str = "base_of") -> DataFrame:
    """(url, depth): what ``crawl`` visits over stored pages, without its rounds of fetching: links of all pages are taken and
    admitted once, and the least depth comes from one search from all seeds together.
    """
    from linkloom.operators.paths import all_pairs
    from linkloom.sources.pages import first_fetch

    stored = written(first_fetch(pages.where("html is not null and html <> ''")).select("url", "html"))
    found = lk.in_domain(lk.resolved(stored.select("url", F.col("url").alias("page_url"), "html"), "url", "page_url"))
    edges = lk.admitted(found.select(F.col("page").alias("src"), F.col("target").alias("dst")).distinct(), known_invalid, rules, match)
    begin = seeds.select("url").where("url is not null").distinct()
    start = begin.select(F.lit("").alias("src"), F.col("url").alias("dst"))  # no address is empty
    reached = all_pairs(edges.unionByName(start), stored.select("url").unionByName(start.select(F.col("src").alias("url"))), sources=start.select(F.col("src").alias("url")).distinct())
    return reached.select(F.col("dst").alias("url"), (F.col("dist") - 1).alias("depth"))


def snapshot_fetcher(pages: DataFrame) -> Fetcher:
    """A fetcher that answers from stored pages; the first fetch of an address (least page_id) with html counts."""
    from linkloom.sources.pages import first_fetch

    stored = written(first_fetch(pages.where("html is not null and html <> ''")).select("url", "html"))
    return lambda wanted: wanted.join(stored, "url", "left").select("url", "html")
