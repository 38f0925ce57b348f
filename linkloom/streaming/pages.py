"""Pages as a stream: links and term counts that grow as pages arrive. An extension; batch gives the same totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import links, terms

PAGES = "page_id bigint, url string, html string, fetched_at timestamp"


def read_pages(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of pages, as they are added to a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def fresh(pages: DataFrame, late: str = "2 days") -> DataFrame:
    """Each address once within the watermark; a page that arrives later than that is dropped."""
    keyed = pages.where("url is not null").withColumn("url", urls.canonical(F.col("url")))
    return keyed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of links inside the site, in append mode."""
    return links.in_domain(links.resolved(pages)).select(F.col("page").alias("src"), F.col("target").alias("dst"))


def term_counts(pages: DataFrame) -> DataFrame:
    """(term, url, n), in update or complete mode."""
    return terms.term_counts(pages.where("url is not null").withColumn("url", urls.canonical(F.col("url"))), "url", F.col("html"), html=True)


def events_by_window(report: DataFrame, wide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, status, events) of crawl events by window of their own time, in append mode; later rows are dropped. Complete mode gives all windows and rows."""
    rows = report.where("status is not null and reported_at is not null").withWatermark("reported_at", late)
    return rows.groupBy(F.window("reported_at", wide), "status").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "status", "events")


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, and gives its result as a table in the shared checkpoint folder.

    append: rows go to the table as they come, each once. complete: the last full result counts.
    """
    from linkloom.session import shared_path

    spark = stream.sparkSession
    base = shared_path(spark, "stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        run = out.format("parquet").start(f"{base}/rows")
    else:
        run = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
