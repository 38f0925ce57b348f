"""Terms of documents and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text

PARTS = 64


def term_counts(documents: DataFrame, key: str, content: Column, html: bool = False, block_separators: bool = False) -> DataFrame:
    """(term, key, n): how often each term stands in each document. ``html``: the content is a page, not plain text.

    Rows with equal keys count together; null contents and keys give none.
    """
    body = text.html_to_text(content, block_separators) if html else content
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key), F.explode(text.tokens(body)).alias("term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, key: str = "url") -> DataFrame:
    """One row: different terms, documents, pairs and occurrences."""
    return counts.agg(F.countDistinct("term").alias("terms"), F.countDistinct(key).alias("documents"), F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))


def matrix(counts: DataFrame, key: str = "url") -> DataFrame:
    """The dense matrix of all terms and all documents, one sparse vector a document: (key, length, terms, n). ``length`` is the number of all
    terms, those not in ``terms`` are 0. A row is as large as its document; ``counts`` has one row for a term and document, and is read twice.
    """
    length = counts.agg(F.countDistinct("term")).first()[0]
    at = F.sort_array(F.collect_list(F.struct("term", "n"))).alias("at")
    return counts.groupBy(key).agg(at).select(key, F.lit(length).cast("bigint").alias("length"), F.col("at.term").alias("terms"), F.col("at.n").alias("n"))


def dense(counts: DataFrame, terms: DataFrame, key: str = "url") -> DataFrame:
    """(term, key, n) for each of the given terms and every document that has any term, 0 where it lacks it. As large as its task; each of ``PARTS`` parts of
    the documents meets the terms for itself.
    """
    documents = counts.select(key).distinct().withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    every = documents.join(terms.select("term", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), "part").drop("part")
    return every.join(counts, ["term", key], "left").select("term", key, F.coalesce("n", F.lit(0)).alias("n"))
