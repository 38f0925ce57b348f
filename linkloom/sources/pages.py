"""Pages as input: stored snapshots, HTML files, and a fetcher over HTTP."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.session import spread, written


def acceptable(content_type: Column) -> Column:
    """Is the media type one that holds html or text?"""
    kind = F.lower(content_type)
    return F.coalesce(kind.contains("html") | kind.contains("text"), F.lit(False))


def first_fetch(pages: DataFrame) -> DataFrame:
    """(url, page_id, html): of all fetches of one address, under any spelling, that with the least page_id. Null addresses drop out.

    Addresses fetched more than once are found from addresses and numbers alone and written, as they are few; the pages then meet
    them in one join, which takes no shuffle of the pages while that table is small enough to be sent along (the engine checks its size).
    Rows that repeat a page_id of an address count once, null ones last.
    """
    keyed = spread(pages.where("url is not null").select("url", "page_id", "html")).select(urls.fenced(urls.canonical(F.col("url"))).alias("url"), "page_id", "html")
    several = keyed.groupBy("url").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"), F.countDistinct("page_id").alias("numbers")).where("rows > 1")
    several = written(several.select("url", "first", (F.col("numbers") < F.col("rows")).alias("tied")))
    met = keyed.join(several, "url", "left")
    once = met.where("tied is null or (not tied and page_id = first)").select("url", "page_id", "html")
    tied = several.where("tied").select("url")
    if tied.isEmpty():
        return once
    again = keyed.join(tied, "url", "left_semi").groupBy("url").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "html")).alias("x"))
    return once.unionByName(again.select("url", "x.page_id", "x.html"))


def fetch_snapshot(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, page_id, fetched): of each wanted address its stored fetch, if any; without html it counts as not fetched."""
    want = wanted.where("url is not null").select(urls.canonical(F.col("url")).alias("url")).distinct()
    got = first_fetch(pages).where("html is not null and html <> ''").select("url", "page_id")
    return want.join(got, "url", "left").withColumn("fetched", F.col("page_id").isNotNull())


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of files read whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def http_get(url: str, timeout: float) -> tuple[str | None, str | None]:
    """(content type, text) of an address; nulls where anything goes wrong."""
    import urllib.request

    try:
        asked = urllib.request.Request(url, headers={"Accept": "text/html"})
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            kind = got.headers.get_content_type()
            return kind, got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
    except Exception:
        return None, None


def fetch(wanted: DataFrame, get: Callable[[str, float], tuple[str | None, str | None]] = http_get, at_once: int = 8, timeout: float = 3600.0) -> DataFrame:
    """(url, html, download_ms): each address fetched once, ``at_once`` side by side; html is null on failure or for another media type.

    ``get`` may be any function of address and timeout that gives content type and text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            rows = []
            for u in frame["url"]:
                began = time.perf_counter()
                kind, text = get(u, timeout)
                good = kind is not None and ("html" in kind.lower() or "text" in kind.lower())
                rows.append((u, text if good else None, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["url", "html", "download_ms"])

    return wanted.select("url").where("url is not null").distinct().repartition(at_once).mapInPandas(run, "url string, html string, download_ms double")
