"""Results as files: pages by path, ranked lists and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls


def page_paths(pages: DataFrame) -> DataFrame:
    """(page_id, directory, path): where a page is saved. Null addresses drop out."""
    u = F.col("url")
    return pages.where("url is not null").select("page_id", urls.directory_name(urls.host_of(u)).alias("directory"), urls.file_path(u).alias("path"))


def save_pages(pages: DataFrame, folder: str) -> None:
    """Pages as a table parted by site, with their paths; a file of its own for each page would not scale."""
    u = F.col("url")
    keyed = pages.where("url is not null").select(urls.directory_name(urls.host_of(u)).alias("directory"), urls.file_path(u).alias("path"), "html")
    keyed.write.mode("overwrite").partitionBy("directory").parquet(folder)


def save_ranked(ranked: DataFrame, value: str, path: str) -> None:
    """Lines "url value" by rank, as text files in order."""
    ranked.orderBy("rank").select(F.concat_ws(" ", "url", F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def save_reports(reports: DataFrame, path: str, ordered: bool = False, compression: str = "none") -> None:
    """Path reports as text, by src and dst. ``ordered``: the rows come so already, and are not sorted again."""
    rows = reports if ordered else reports.orderBy("src", "dst")
    rows.select(F.col("report").alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def report_lines(lines: DataFrame, alone: bool) -> DataFrame:
    """(line, n) of the lines of path reports, each pair reported once. ``alone``: no other line looks like a heading; then a heading that can be read in one way is
    that of one pair, once in the file, and only the other lines are gathered (there are as many headings as pairs).
    """
    line = F.col("value").alias("line")
    if not alone:
        return lines.groupBy(line).agg(F.count("*").alias("n"))
    sure = F.startswith("value", F.lit("Path from ")) & (F.regexp_count("value", F.lit("(?= to )")) == 1)
    return lines.where(sure).select(line, F.lit(1).cast("bigint").alias("n")).unionByName(lines.where(~sure).groupBy(line).agg(F.count("*").alias("n")))
