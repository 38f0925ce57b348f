"""Link graphs: vertices (url), edges (src, dst) as a multiset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.session import spread


def prune_documents(documents: DataFrame, invalid: DataFrame) -> DataFrame:
    """(url) of documents that were analysed and did not fail, canonical and distinct. Null urls and null flags do not count."""
    bad = invalid.where("url is not null").select(urls.canonical(F.col("url")).alias("url"))
    return documents.where("analyzed and url is not null").select(urls.canonical(F.col("url")).alias("url")).distinct().join(bad, "url", "left_anti")


def canonical_edges(edges: DataFrame) -> DataFrame:
    return spread(edges.select("src", "dst")).where("src is not null and dst is not null").select(urls.canonical(F.col("src")).alias("src"), urls.canonical(F.col("dst")).alias("dst"))


def prune_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between vertices; repeated edges stay."""
    e = canonical_edges(edges)
    for side in ("src", "dst"):
        e = e.join(vertices.select(F.col("url").alias(side)), side, "left_semi")
    return e.select("src", "dst")


def multiplicity(edges: DataFrame) -> DataFrame:
    """(src, dst, n): distinct edges with their number."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, indegree, outdegree) of every vertex, with repeated edges, 0 included. Counts are made before the joins, so hubs do not weigh."""
    ins = edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("indegree"))
    outs = edges.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("outdegree"))
    d = vertices.select("url").join(ins, "url", "left").join(outs, "url", "left")
    return d.select("url", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("indegree", "outdegree")))


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, arrows, sum of in- and outdegrees, mean degrees (null without vertices)."""
    d = degrees(vertices, edges)
    return d.agg(
        F.count("*").alias("vertices"), F.coalesce(F.sum("indegree"), F.lit(0)).alias("total_in"), F.coalesce(F.sum("outdegree"), F.lit(0)).alias("total_out"),
        F.avg("indegree").alias("mean_in"), F.avg("outdegree").alias("mean_out"),
    )


def distribution(vertices: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(rank, url, degree) by falling degree; ties by url. kind: in or out."""
    d = degrees(vertices, edges).select("url", F.col(f"{kind}degree").alias("degree"))
    return ranked(d, "degree")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """Adds ``rank`` from 1 by falling ``by``, ties by url: a range sort, and numbers from the sizes of its parts, so no task holds all rows."""
    from pyspark.sql import Window

    from linkloom.session import cut_lineage

    parts = cut_lineage(df.orderBy(F.desc_nulls_last(by), "url").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))  # one row a partition
    before = sizes.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "first")
    own = Window.partitionBy("part").orderBy(F.desc_nulls_last(by), "url")
    return parts.withColumn("nth", F.row_number().over(own)).join(before, "part").select((F.col("first") + F.col("nth")).alias("rank"), *df.columns)
