"""Probabilistic latent semantic analysis by expectation maximisation over sparse counts.

Counts are (term, url, n); topics are 1 to K. P(w|z) is an array of K by term, P(z|d) an array of K by url. Absent pairs count
0 and add nothing, so only pairs that exist are read. Topics are updated one after the other, and later ones see the values of
the earlier; "simultaneous" updates them at once. A zero denominator adds nothing.

Single steps are joins. ``fit`` has a second plan, of the same values: while terms and documents are few (a checked bound) both tables are
sent to the workers as numbers, the counts are laid out once by document, and an update reads them once without a shuffle of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import written

MODULUS = 1_000_003
KEYS = 2_000_000  # terms and documents, times topics by 3, up to which both tables are sent to the workers
PIECE = 100_000  # counts of whole documents that are kept as one row
SLICES = 64  # of the terms, by which sums are added up
PARTS = 4  # that the documents of a term, and the terms of a document, are summed in


def start_value(key: Column, topic: int) -> Column:
    """A number above 0 and below 1 from key and topic, the same in any engine: 8 hexadecimal digits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{topic}"))), 1, 8), 16, 10).cast("bigint")
    return (h % MODULUS + 1) / F.lit(float(MODULUS + 1))


@dataclass
class Model:
    terms: DataFrame  # (term, p)
    documents: DataFrame  # (url, p)
    topics: int


def _shared(keys: DataFrame, key: str, topics: int) -> DataFrame:
    raw = keys.select(key, F.array(*(start_value(F.col(key), z) for z in range(1, topics + 1))).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return raw.select(key, F.transform("u", lambda x: x / total).alias("p"))


def start(counts: DataFrame, topics: int) -> Model:
    """Both tables with start values, each row made to add up to 1 over the topics."""
    return Model(_shared(counts.select("term").distinct(), "term", topics), _shared(counts.select("url").distinct(), "url", topics), topics)


def _put(p: str, z: int, value: Column, topics: int) -> Column:
    return F.array(*(value if k == z else F.get(p, F.lit(k)) for k in range(topics)))


def _half(counts: DataFrame, own: DataFrame, other: DataFrame, key: str, topics: int, update: str, scale: bool) -> DataFrame:
    """New values of ``own`` (key, p), given the other side: each p of a topic times the sum of n * other's p / chance of the pair.

    The other side is joined to the counts once, and laid out by key and a part of the other keys, so that no topic shuffles it again and a term on very
    many documents is in ``PARTS`` tasks; sums of the parts are added up by key. With ``scale`` each topic is made to
    add up to 1 over the rows before the next, by sums of which one number a topic comes to the driver.
    """
    far = "url" if key == "term" else "term"
    part = F.pmod(F.xxhash64(far), F.lit(PARTS)).cast("int")
    fixed = written(counts.join(other.withColumnRenamed("p", "q"), far).select(key, part.alias("part"), "n", "q"), by=[key, "part"])
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    for some in [[z] for z in range(topics)] if update == "sequential" else [list(range(topics))]:
        both = fixed.join(own.select(key, "p", parts), [key, "part"])
        mixed = sum((F.get("p", F.lit(k)) * F.get("q", F.lit(k)) for k in range(topics)), F.lit(0.0))
        share = both.withColumn("r", F.when(mixed > 0, F.col("n") / mixed).otherwise(0.0))
        sums = share.groupBy(key, "part").agg(F.first("p").alias("p"), *(F.sum(F.col("r") * F.get("q", F.lit(z))).alias(f"t{z}") for z in some))
        new = sums.groupBy(key).agg(F.first("p").alias("p"), *(F.sum(f"t{z}").alias(f"t{z}") for z in some))
        for z in some:
            new = new.withColumn("p", _put("p", z, F.get("p", F.lit(z)) * F.col(f"t{z}"), topics))
        own = written(new.select(key, "p"))
        if scale:
            total = own.agg(*(F.sum(F.get("p", F.lit(z))) for z in some)).first()
            for z, t in zip(some, total, strict=True):
                own = own.withColumn("p", _put("p", z, F.get("p", F.lit(z)) / F.lit(t) if t else F.lit(0.0), topics))
    return own


def step_terms(counts: DataFrame, m: Model, update: str = "sequential") -> Model:
    """New P(w|z), each topic adding up to 1 over the terms."""
    return Model(_half(counts, m.terms, m.documents, "term", m.topics, update, True), m.documents, m.topics)


def step_documents(counts: DataFrame, m: Model, update: str = "sequential") -> Model:
    """New P(z|d), each document adding up to 1 over the topics at the end."""
    new = _half(counts, m.documents, m.terms, "url", m.topics, update, False)
    done = new.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    done = done.select("url", F.transform("p", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)).alias("p"))
    return Model(m.terms, done, m.topics)


def _table(df: DataFrame, key: str) -> tuple[pa.Array, np.ndarray]:
    """The keys, in order, and their p."""
    t = df.toArrow()
    t = t.take(pc.sort_indices(t[key]))
    keys, p = t[key].combine_chunks(), t["p"].combine_chunks()
    return keys, p.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1).copy()


def _pieces(counts: DataFrame, terms: pa.Array, documents: pa.Array) -> DataFrame:
    """(d, t, n): numbers of documents and terms, and counts, of all counts of some documents, as bytes; written."""
    shared = counts.sparkSession.sparkContext.broadcast((terms, documents))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, documents = shared.value
        waiting: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            term, url, n = (pa.chunked_array([b.column(k) for b in waiting]).combine_chunks() for k in range(3))
            of = [pc.index_in(x.cast(pa.string()), value_set=y) for x, y in ((url, documents), (term, terms))]
            waiting.clear()
            whole = pc.and_(of[0].is_valid(), of[1].is_valid())
            return pa.RecordBatch.from_arrays([x.filter(whole) for x in (*of, n)], names=["d", "t", "n"])

        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= PIECE:  # as the keys are laid out for each call
                yield out()
        if waiting:
            yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def row(x: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in x], names=["d", "t", "n"])

        for b in batches:
            new = [b.column(k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in enumerate((np.int32, np.int32, np.int64))]
            rest = new if rest is None else [np.append(x, y) for x, y in zip(rest, new, strict=True)]
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last document may go on
            if cut >= PIECE:
                yield row([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield row(rest)

    numbers = counts.select("term", "url", "n").mapInArrow(number, "d int, t int, n bigint")
    return written(numbers.repartition("d").sortWithinPartitions("d").mapInArrow(pack, "d binary, t binary, n binary"))


def _pass(pieces: DataFrame, w: np.ndarray, p: np.ndarray, update: str, documents: bool, some: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """One reading of the counts. With ``documents`` new P(z|d) given ``w``; then, with these, the sums by term for topics ``some``, and the log-likelihood."""
    topics = w.shape[1]
    shared = pieces.sparkSession.sparkContext.broadcast((w, p))
    blocks = [[z] for z in range(topics)] if update == "sequential" else [list(range(topics))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = shared.value
        sums, gain = np.zeros((len(w), len(some))), 0.0

        def row(kind: int, key: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([kind], pa.int32()), pa.array([key], pa.int32()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "ids", "x"])

        def shares(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mixed = np.einsum("ij,ij->i", a, b)
            return mixed, np.divide(n, mixed, out=np.zeros(len(n)), where=mixed > 0)

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, t, n = (np.frombuffer(b, kind) for b, kind in zip(x, (np.int32, np.int32, np.int64), strict=True))
                ids, at = np.unique(d, return_inverse=True)
                own, far = p[ids], w[t]
                if documents:
                    for block in blocks:
                        _, r = shares(n, own[at], far)
                        for z, total in [(z, np.bincount(at, r * far[:, z], len(ids))) for z in block]:
                            own[:, z] *= total
                    total = own.sum(axis=1, keepdims=True)
                    own = np.divide(own, total, out=np.zeros_like(own), where=total > 0)
                    yield row(0, int(ids[0]) % SLICES, ids, own)
                mixed, r = shares(n, own[at], far)
                good = mixed > 0
                gain += float((n[good] * np.log(mixed[good])).sum())
                for k, z in enumerate(some):
                    sums[:, k] += np.bincount(t, r * own[at, z], len(w))
        met = np.flatnonzero(sums.any(axis=1))
        for key, few in enumerate(np.split(met, np.searchsorted(met, np.arange(1, SLICES) * len(w) / SLICES))):
            if len(few):
                yield row(1, key, few, sums[few])
        yield row(2, 0, np.zeros(1), np.array([[gain]]))

    def pairs(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = np.frombuffer(ids, np.int32)
        return k, np.frombuffer(x).reshape(len(k), -1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, key, ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != 1:
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([ids], pa.binary()), pa.array([x], pa.binary())], names=["kind", "ids", "x"])
                    continue
                low = -(-key * terms_of // SLICES)
                few, values = pairs(ids, x)
                sums.setdefault(key, np.zeros((terms_of // SLICES + 1, len(some))))[few - low] += values  # a task has a term once
        for key, values in sums.items():
            few = np.flatnonzero(values.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([(few - (-key * terms_of // SLICES)).astype(np.int32).tobytes()], pa.binary()), pa.array([values[few].tobytes()], pa.binary())], names=["kind", "ids", "x"])

    terms_of = len(w)
    found = pieces.mapInArrow(run, "kind int, key int, ids binary, x binary").repartition("key").mapInArrow(merge, "kind int, ids binary, x binary").toArrow()
    shared.destroy()
    new, sums, gain = p.copy(), np.zeros((len(w), len(some))), 0.0
    for kind, ids, x in zip(*(c.to_pylist() for c in found.columns), strict=True):
        k, values = pairs(ids, x)
        if kind == 0:
            new[k] = values
        elif kind == 1:
            sums[k] = values
        else:
            gain += float(values[0, 0])
    return new, sums, gain


def _fit_few(counts: DataFrame, m: Model, iterations: int, update: str, tol: float | None) -> Model:
    spark = counts.sparkSession
    (terms, w), (documents, p) = _table(m.terms, "term"), _table(m.documents, "url")
    pieces = _pieces(counts, terms, documents)
    blocks = [[z] for z in range(m.topics)] if update == "sequential" else [list(range(m.topics))]
    last = None
    _, sums, _ = _pass(pieces, w, p, update, False, blocks[0])
    for _ in range(iterations):
        for k, block in enumerate(blocks):
            if k:
                _, sums, _ = _pass(pieces, w, p, update, False, block)
            for z, total in zip(block, sums.T, strict=True):
                w[:, z] *= total
                whole = w[:, z].sum()
                w[:, z] = w[:, z] / whole if whole else 0.0
        p, sums, now = _pass(pieces, w, p, update, True, blocks[0])  # and the sums that the next iteration begins with
        if tol is not None:
            if last is not None and abs(now - last) <= tol * abs(last):
                break
            last = now

    def frame(key: str, keys: pa.Array, values: np.ndarray) -> DataFrame:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * m.topics), pa.array(values.ravel()))
        return spark.createDataFrame(pa.table({key: keys, "p": lists}), f"{key} string, p array<double>")

    return Model(frame("term", terms, w), frame("url", documents, p), m.topics)


def fit(counts: DataFrame, topics: int = 3, iterations: int = 1, update: str = "sequential", tol: float | None = None, limit: int = KEYS) -> Model:
    """A model after so many iterations, or fewer when with ``tol`` the log-likelihood grows by a smaller share than that."""
    if update not in ("sequential", "simultaneous"):
        raise ValueError(f"update {update!r}")
    counts = written(counts.select("term", "url", F.col("n").cast("bigint").alias("n")))
    m = start(counts, topics)
    if limit > 0 and iterations > 0:
        m = Model(written(m.terms.where("term is not null")), written(m.documents.where("url is not null")), topics)
        if 0 < m.terms.count() + m.documents.count() <= limit * 3 // max(topics, 3):
            return _fit_few(counts, m, iterations, update, tol)
    last = None
    for _ in range(iterations):
        m = step_documents(counts, step_terms(counts, m, update), update)
        if tol is not None:
            now = log_likelihood(counts, m)
            if last is not None and abs(now - last) <= tol * abs(last):
                break
            last = now
    return m


def log_likelihood(counts: DataFrame, m: Model) -> float:
    both = counts.join(m.terms.withColumnRenamed("p", "w"), "term").join(m.documents.withColumnRenamed("p", "d"), "url")
    mixed = sum((F.get("w", F.lit(k)) * F.get("d", F.lit(k)) for k in range(m.topics)), F.lit(0.0))
    return both.agg(F.sum(F.when(mixed > 0, F.col("n") * F.ln(mixed)))).first()[0] or 0.0


def by_topic(table: DataFrame, key: str) -> DataFrame:
    """(key, topic, p) in rows; topic counts from 1."""
    return table.select(key, F.posexplode("p").alias("pos", "p")).select(key, (F.col("pos") + 1).alias("topic"), "p")


def row_sums(table: DataFrame, key: str) -> DataFrame:
    """(key, total): sum over the topics."""
    return table.select(key, F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"))


def topic_filter(documents: DataFrame, topics: int, factor: float = 2.0) -> DataFrame:
    """(topic, url, p): documents under the topic of their largest share, all of them on ties, where it is at least factor / topics."""
    best = F.array_max("p")
    rows = documents.where(best >= factor / topics).select("url", F.posexplode("p").alias("pos", "p"), best.alias("best"))
    return rows.where("p = best").select((F.col("pos") + 1).alias("topic"), "url", "p")


def report_lines(table: DataFrame, key: str, topic_first: bool) -> DataFrame:
    """(topic, key, line): "[key,Topic z]=p", or with the topic first, with six places."""
    rows = by_topic(table, key)
    name = F.concat(F.lit("Topic "), F.col("topic").cast("string"))
    inside = F.concat_ws(",", name, F.col(key)) if topic_first else F.concat_ws(",", F.col(key), name)
    return rows.select("topic", key, F.concat(F.lit("["), inside, F.lit("]="), F.format_string("%.6f", F.col("p"))).alias("line"))
