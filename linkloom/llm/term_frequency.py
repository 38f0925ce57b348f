"""How often every term occurs, and in how many records, by last-seen counters.

Rows (term, record) are partitioned by a hash of the term and of a slice of the record, and ordered by record within each
partition. A partition then holds for each of its terms three numbers: occurrences, records, and the last record seen;
a row adds to the records only where its record differs from the last. No set of records is kept for any term. The slices
hold disjoint records, so their counts add up; they part a term that a third of all rows may have.

Rows of one term and record in a batch are added up before they are partitioned. Each batch of rows also yields its different records once under the empty term, which no row can have: that term's number
of records is the number of all records, terms or not, from the same reading.

Terms count as equal after removing format characters (category Cf), NFC, lower-casing and trimming white space.
Records are told apart by a 128-bit hash of their address, cut and normalised as in functions.urls.canonical.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.pages import same_url
from linkloom.session import parts_for, written

SLICES = 8  # at least; half the cores where these are more


@lru_cache(1 << 17)
def term_key(term: str) -> str:
    """Equal for equal terms; empty where nothing is left."""
    if term.isascii():
        return term.lower().strip()
    kept = "".join(c for c in term if unicodedata.category(c) != "Cf")
    return unicodedata.normalize("NFC", kept).lower().strip()


@lru_cache(1 << 14)
def record_key(url: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(same_url(url).encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 16):
            part = b.slice(at, 1 << 16)
            term, url = (pc.dictionary_encode(part.column(k)) for k in ("term", "record"))
            # rows of one term and record are one from here on
            number: dict[str, int] = {}
            same = np.array([number.setdefault(term_key(t), len(number)) for t in term.dictionary.to_pylist()] + [-1], np.int64)
            keys = np.array([record_key(u) for u in url.dictionary.to_pylist()], np.int64).reshape(-1, 2)
            _, own = np.unique(keys, axis=0, return_inverse=True)
            code = same[pc.fill_null(term.indices, len(same) - 1).to_numpy(zero_copy_only=False)]
            place = url.indices.to_numpy(zero_copy_only=False)
            held = (code >= 0) & (code != number.get("", -1))
            pair = code[held] * max(1, len(keys)) + own.ravel()[place[held]]
            _, first, of = np.unique(pair, return_index=True, return_inverse=True)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, of.ravel(), part.column("n").to_numpy(zero_copy_only=False)[held])
            rec = keys[place[held][first]]
            names = pa.array(list(number), pa.string()).take(pa.array(code[held][first]))
            yield pa.RecordBatch.from_arrays([names, pa.array(rec[:, 0]), pa.array(rec[:, 1]), pa.array(n)], names=["term", "r1", "r2", "n"])
            every = np.unique(keys, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(every), pa.string()), pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(np.zeros(len(every), np.int64))], names=["term", "r1", "r2", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[str, int] = {}
    size = 1 << 12
    seen, records = np.zeros(size, np.int64), np.zeros(size, np.int64)
    last = np.zeros((size, 2), np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        term = pc.dictionary_encode(b.column("term"))
        code = np.array([ids.setdefault(t, len(ids)) for t in term.dictionary.to_pylist()], np.int64)[term.indices.to_numpy(zero_copy_only=False)]
        while len(ids) > size:
            seen, records, last = (np.concatenate([x, np.zeros_like(x)]) for x in (seen, records, last))
            size *= 2
        np.add.at(seen, code, b.column("n").to_numpy(zero_copy_only=False))
        order = np.argsort(code, kind="stable")
        code = code[order]
        rec = np.stack([b.column("r1").to_numpy()[order], b.column("r2").to_numpy()[order]], axis=1)
        first = np.append(True, code[1:] != code[:-1])
        before = np.empty_like(rec)
        before[1:] = rec[:-1]
        own = code[first]
        before[first] = last[own]
        new = (rec != before).any(axis=1)
        new[first] |= records[own] == 0
        records += np.bincount(code[new], minlength=size)
        ends = np.append(np.nonzero(first)[0][1:], len(code)) - 1
        last[own] = rec[ends]
    if ids:
        k = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(list(ids)), pa.array(seen[:k]), pa.array(records[:k])], names=["term", "occurrences", "records"])


def _all_counts(rows: DataFrame, term: str, record: str, n: str | None, slices: int | None) -> DataFrame:
    slices = slices or max(SLICES, rows.sparkSession.sparkContext.defaultParallelism // 2)
    amount = F.lit(1) if n is None else F.coalesce(F.col(n), F.lit(0))
    use = rows.select(F.col(term).alias("term"), F.col(record).alias("record"), amount.cast("bigint").alias("n")).where("record is not null")
    keyed = use.mapInArrow(_normalised, "term string, r1 bigint, r2 bigint, n bigint")
    parts = keyed.repartition(parts_for(use), F.col("term"), F.pmod(F.col("r1"), F.lit(slices))).sortWithinPartitions("r1", "r2")
    counted = parts.mapInArrow(_counted, "term string, occurrences bigint, records bigint")
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequency(rows: DataFrame, term: str, record: str, n: str | None = None, slices: int | None = None) -> DataFrame:
    """(term, occurrences, records) of every term.

    Rows with a null term or record, and terms of which nothing is left, do not count. ``n``: occurrences in a row; null
    or missing ones count as 0 occurrences, but the record counts. Repeated rows add occurrences, not records.
    """
    return _all_counts(rows, term, record, n, slices).where("term <> ''")


def marked_terms(rows: DataFrame, term: str, record: str, n: str | None = None, least: int = 3, share: float = 0.3) -> DataFrame:
    """Every term with its counts and ``mark``: rare below ``least`` records, else common above ``share`` of all records, else null.

    The counts, one row for each term, are written once and read for the total and the marks.
    """
    counts = written(_all_counts(rows, term, record, n, None))
    total = F.broadcast(counts.where("term = ''").select(F.col("records").alias("all_records")))  # one row, or none for no rows
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > F.col("all_records") * share, "common")
    return counts.where("term <> ''").join(total).select("term", "occurrences", "records", mark.alias("mark"))
