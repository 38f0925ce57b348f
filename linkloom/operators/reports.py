"""Reports on documents and on the crawl's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators.graph import degrees

# Where an event of each kind is shown.
PLACES = {
    "UrlProcessed": "urls", "UrlError": "errors", "UrlSkippedExternal": "skipped", "UrlSkippedFile": "skipped", "Information": "information", "ShortestPaths": "information",
    "ProbabilisticLSA": "topics", "PLSATopicByDocument": "topic_by_document", "PLSATopicByTerms": "topic_by_terms", "PLSADocumentByTopic": "document_by_topic", "PLSATermsByTopic": "terms_by_topic",
}


def routing(report: DataFrame) -> DataFrame:
    """(place, status, events, urls, first_seq, last_seq): events by place of display. Repeated rows count once, unknown statuses go to "other"."""
    place = F.coalesce(F.create_map(*(F.lit(x) for kv in PLACES.items() for x in kv))[F.col("status")], F.lit("other"))
    rows = report.where("status is not null").select("status", "seq", "url", "message").distinct().withColumn("place", place)
    return rows.groupBy("place", "status").agg(F.count("*").alias("events"), F.countDistinct("url").alias("urls"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def document_report(documents: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, pagerank, download_ms, indegree, outdegree, inlinks, outlinks) of every vertex; links sorted, repeated ones included.

    The link lists are the report's own form; of a vertex they are as long as its degrees.
    """
    known = documents.where("url is not null").groupBy(urls.canonical(F.col("url")).alias("url")).agg(F.max("pagerank").alias("pagerank"), F.max("download_ms").alias("download_ms"))
    ins = edges.groupBy(F.col("dst").alias("url")).agg(F.sort_array(F.collect_list("src")).alias("inlinks"))
    outs = edges.groupBy(F.col("src").alias("url")).agg(F.sort_array(F.collect_list("dst")).alias("outlinks"))
    d = degrees(vertices, edges).join(known, "url", "left").join(ins, "url", "left").join(outs, "url", "left")
    none = F.array().cast("array<string>")
    return d.select("url", "pagerank", "download_ms", "indegree", "outdegree", F.coalesce("inlinks", none).alias("inlinks"), F.coalesce("outlinks", none).alias("outlinks"))
