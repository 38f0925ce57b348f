"""Links of pages: extraction, resolution, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators import robots as rb
from linkloom.session import spread


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of each double-quoted link of the raw page, comments and scripts included. pos counts from 0."""
    return spread(pages.select(key, html)).select(key, F.posexplode(text.hrefs(F.col(html))).alias("pos", "href"))


def resolved(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", mode: str = "domain") -> DataFrame:
    """(key, page, pos, href, target): target is the canonical address, null where the link is not usable. Pages without address or html have none."""
    rows = spread(pages.select(*dict.fromkeys((key, url, html)))).select(F.col(key), urls.canonical(F.col(url)).alias("page"), F.posexplode(text.hrefs(F.col(html))).alias("pos", "href"))
    return urls.resolve(rows.where("page is not null"), "href", "page", "target", mode)


def in_domain(links: DataFrame) -> DataFrame:
    """Links whose target lies in the site of the page: same scheme, host and port."""
    return links.where("target is not null").where(urls.is_base_of(F.concat(urls.root_of(F.col("page")), F.lit("/")), F.col("target")))


def disposition(links: DataFrame, invalid: DataFrame, rules: DataFrame, match: str = "base_of") -> DataFrame:
    """Adds ``disposition``, the first that holds: malformed, file, external, invalid, disallowed, admitted.

    ``links``: as of ``resolved``. The rules of a site are joined by its host; the tables may be of any size.
    """
    bad = invalid.where("url is not null").select(urls.canonical(F.col("url")).alias("target")).distinct().withColumn("failed", F.lit(True))
    inside = urls.is_base_of(F.concat(urls.root_of(F.col("page")), F.lit("/")), F.col("target"))
    kind = (
        F.when(urls.cut(F.col("href")).rlike("(?i)^file:"), "file")
        .when(F.col("target").isNull(), "malformed")
        .when(~inside, "external")
        .when(F.col("failed"), "invalid")
        .when(F.col("forbidden"), "disallowed")
        .otherwise("admitted")
    )
    return rb.with_forbidden(links, "target", rules, match).join(bad, "target", "left").select(*links.columns, kind.alias("disposition"))


def admitted(edges: DataFrame, invalid: DataFrame, rules: DataFrame, match: str = "base_of") -> DataFrame:
    """(src, dst): edges whose target is known, did not fail and is not forbidden. Repeated edges stay."""
    e = spread(edges.select("src", "dst")).where("src is not null and dst is not null").select(urls.canonical(F.col("src")).alias("src"), urls.fenced(urls.canonical(F.col("dst"))).alias("dst"))
    bad = invalid.where("url is not null").select(urls.canonical(F.col("url")).alias("dst"))
    return rb.with_forbidden(e.join(bad, "dst", "left_anti"), "dst", rules, match).where("not forbidden").select("src", "dst")
