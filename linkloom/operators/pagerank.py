"""PageRank over a multigraph.

A vertex passes its rank on once to each vertex it links to, divided by the number of all its links, repeated ones
included (``dedupe`` divides by distinct links). Ranks of vertices without links are not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import multiplicity
from linkloom.session import written

DAMPING = 0.85


def pagerank(vertices: DataFrame, edges: DataFrame, steps: int = 10, tol: float | None = None, stop: str = "all", dedupe: bool = False) -> DataFrame:
    """(url, pagerank). All ranks of a step come from the step before.

    Without ``tol`` exactly ``steps`` steps. With it, at most ``steps``, ended when the ranks of all vertices (stop
    "all") or of any vertex ("any") change by ``tol`` or less. No vertices give no rows.
    """
    if stop not in ("all", "any"):
        raise ValueError(f"stop {stop!r}")
    v = written(vertices.select("url").distinct())
    n = v.count()
    if not n:
        return v.withColumn("pagerank", F.lit(0.0))
    many = multiplicity(edges)
    out = many.groupBy("src").agg((F.count("*") if dedupe else F.sum("n")).alias("links"))
    arcs = written(many.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("links")).alias("share")), by="src")  # no step shuffles them again
    ranks = v.withColumn("pagerank", F.lit(1.0 / n))
    base = (1 - DAMPING) / n
    for step in range(1, steps + 1):
        given = arcs.join(ranks, arcs.src == ranks.url).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        new = v.join(given, v.url == given.dst, "left").select("url", (F.lit(base) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if tol is None:
            ranks = written(new) if step % 5 == 0 and step < steps else new
            continue
        new = written(new)
        moved = new.join(ranks.select("url", F.col("pagerank").alias("old")), "url").select((F.abs(F.col("pagerank") - F.col("old")) > tol).alias("moving"))
        going = moved.agg((F.bool_or("moving") if stop == "all" else F.every("moving")).alias("going")).first()["going"]
        ranks = new
        if not going:
            break
    return ranks
