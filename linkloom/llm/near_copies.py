"""Near copies by an inverted join over signature coordinates.

Each text is a set of word runs (shingles). Minima of ``MINIMA`` hash functions are taken, two at a time, as the ``COORDINATES``
of its signature: sets of similarity s agree in a coordinate with the chance s * s. A pair counts as a match from T agreements on. Texts are
posted under coordinate-value pairs, the posting lists are merged, and collisions of each pair are counted.

* Prefix: a pair with T agreements has at least two of them among the COORDINATES - T + 2 first of each text, by any order common to all. Only
  these are posted, and only pairs that collide twice go on.
* Skip: a list longer than ``HOT``, as a common shingle makes, is not merged. Its texts are posted again under each two of their skipped
  coordinates, as a pair that has no two collisions elsewhere must share two of these, or one of each kind. A text with one skipped
  coordinate so meets nobody for it. Lists that are still long are parted into blocks, and pairs of blocks are merged one by one.
* The collisions that were not merged are then looked up: pairs stay whose signatures agree in T coordinates, and in as many single minima as
  the similarity asks for. What is left is held against the threshold by the whole sets.

Equal sets are one class from the start: a representative is posted, and its members come back at the end. The chance to
lose a pair at a similarity of exactly the threshold is that of fewer agreements than T, and than the single minima ask for: at most 1 in 10,000 each (``MISS``); it falls fast above.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_rows, spread
from linkloom.session import cut_lineage, parts_for, written

WORD = re.compile(r"[^\W_]+")
MINIMA, COORDINATES = 96, 48
MISS = 1e-4
HOT = 1000  # texts in a posting list from which it is skipped, and in a block of a long list
CHUNK = 1 << 14  # shingles hashed at once
SALT = np.random.default_rng(20240229)
A = SALT.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
B = SALT.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


@lru_cache(1 << 17)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingles(text: str | None, width: int, short: bool = False) -> np.ndarray:
    """Distinct hashed runs of ``width`` words, sorted. Fewer words than that, and null, give none; with ``short`` fewer words give one run of
    them all.
    """
    words = WORD.findall((text or "").lower())
    if short and words:
        width = min(width, len(words))
    if len(words) < width:
        return np.zeros(0, np.uint64)
    w = np.array([word_hash(x) for x in words], dtype=np.uint64)
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(own: np.ndarray) -> np.ndarray:
    """Minima of the hash functions, as 32-bit numbers."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(own), CHUNK):
        low = np.minimum(low, ((own[k : k + CHUNK, None] * A[None, :] + B[None, :]) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def coordinates(low: np.ndarray) -> np.ndarray:
    """Coordinate and value as one 64-bit number, two minima each."""
    two = (low[0::2].astype(np.uint64) << np.uint64(32)) | low[1::2].astype(np.uint64)
    keys = (two + np.arange(COORDINATES, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


@lru_cache(16)
def fewest(of: int, chance: float) -> int:
    """The largest T such that fewer than T of so many agreements have a chance of at most MISS; 1 at least."""
    total, t = 0.0, 0
    while (total := total + comb(of, t) * chance**t * (1 - chance) ** (of - t)) <= MISS:
        t += 1
    return max(1, t)


def features(rows: DataFrame, run: Callable[[dict[str, list]], list[np.ndarray]], kind: str) -> DataFrame:
    """(key, n, same, at, sketch, own) of each row that has shingles. ``run`` gives the shingles of rows.

    same: 128-bit hash of the set; at: its coordinate-value pairs; sketch: the last byte of each minimum; own: the set, 32 bits each.
    """

    def go(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("key", "n", "same", "at", "sketch", "own")}
        for key, own in zip(x["key"], run(x), strict=True):
            if len(own):
                low = minima(own)
                out["key"].append(key)
                out["n"].append(len(own))
                out["same"].append(xxhash.xxh3_128_digest(own.tobytes()))
                out["at"].append(coordinates(low).tobytes())
                out["sketch"].append(low.astype(np.uint8).tobytes())
                out["own"].append((own >> np.uint64(32)).astype(np.uint32).tobytes())
        return out

    return map_rows(rows, go, f"key {kind}, n int, same binary, at binary, sketch binary, own binary")


def _matrix(column: pa.Array, kind: type, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, wide)


def _postings(reps: DataFrame, keep: int) -> DataFrame:
    """(at, key, n): each text under its ``keep`` first coordinate-value pairs, by their numbers."""
    kind = dict(reps.dtypes)["key"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.sort(_matrix(b.column("at"), np.uint64, COORDINATES), axis=1)[:, :keep].astype(np.int64).ravel()
                row = pa.array(np.repeat(np.arange(b.num_rows), keep))
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column("key").take(row), b.column("n").take(row)], names=["at", "key", "n"])

    return reps.select("key", "n", "at").mapInArrow(go, f"at bigint, key {kind}, n int")


def _pairs_of(at: np.ndarray, n: np.ndarray, begin: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs in the given lists whose sizes allow the similarity; lists of equal size are taken together."""
    first, second = [], []
    for k in np.unique(size):
        i, j = np.triu_indices(int(k), 1)
        step = max(1, (1 << 20) // len(i))
        own = begin[size == k]
        for m in range(0, len(own), step):
            x, y = (own[m : m + step, None] + i).ravel(), (own[m : m + step, None] + j).ravel()
            fit = (n[x] >= similarity * n[y]) & (n[y] >= similarity * n[x])
            first.append(x[fit])
            second.append(y[fit])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(posts: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b, at, n): pairs of each posting list, a < b, with null at; and the postings (a, at, n) of lists longer than ``hot``, with null b.

    A partition is read in the order of its lists; of a long list no more than ``hot`` rows and a batch are held.
    """
    kind = dict(posts.dtypes)["key"]
    names = ["a", "b", "at", "n"]

    def skipped(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        return pa.RecordBatch.from_arrays([t["key"].combine_chunks() if t.num_rows else pa.array([], t.schema.field("key").type), pa.nulls(t.num_rows, t.schema.field("key").type), *(t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("at", "n"))], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        long: int | None = None  # the list that is being skipped
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if long is not None:
                here = int(np.searchsorted(b.column("at").to_numpy(), long, side="right"))
                if here:
                    yield skipped(t.slice(0, here))
                    t = t.slice(here)
                if not t.num_rows:
                    continue
                long = None
            t = pa.concat_tables([held, t]) if held is not None else t
            at = t["at"].to_numpy()
            last = int(np.searchsorted(at, at[-1], side="left"))
            if len(at) - last > hot:
                yield from lists(t.slice(0, last))
                yield skipped(t.slice(last))
                held, long = None, int(at[-1])
            else:
                yield from lists(t.slice(0, last))
                held = t.slice(last)
        if held is not None:
            yield from lists(held)

    def lists(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        at, n = t["at"].to_numpy(), t["n"].to_numpy()
        begin = np.append(0, np.nonzero(at[1:] != at[:-1])[0] + 1)
        size = np.diff(np.append(begin, len(at)))
        for x in np.nonzero(size > hot)[0]:
            yield skipped(t.slice(int(begin[x]), int(size[x])))
        some = (size > 1) & (size <= hot)
        x, y = _pairs_of(at, n, begin[some], size[some], similarity)
        if len(x):
            key = t["key"].combine_chunks()
            none = lambda kind: pa.nulls(len(x), kind)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(x)), key.take(pa.array(y)), none(pa.int64()), none(pa.int32())], names=names)

    ordered = posts.repartition(parts_for(posts), "at").sortWithinPartitions("at", "key")
    return ordered.mapInArrow(go, f"a {kind}, b {kind}, at bigint, n int")


def skipped_pairs(skipped: DataFrame, similarity: float, two: bool, hot: int = HOT) -> DataFrame:
    """(a, b) of texts that share two skipped coordinates, or one where ``two`` is not set. ``skipped``: (a, at, n)."""
    if two:
        held = skipped.groupBy(F.col("a").alias("key")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list("at")).alias("ats"))  # COORDINATES at most
        each = held.where(F.size("ats") > 1).select("key", "n", F.posexplode("ats").alias("i", "x"), "ats")
        posts = each.select("key", "n", "x", F.explode(F.slice("ats", F.col("i") + 2, F.size("ats"))).alias("y")).select("key", "n", F.xxhash64("x", "y").alias("at"))
    else:
        posts = skipped.select(F.col("a").alias("key"), "n", "at")
    posts = written(posts)
    many = posts.groupBy("at").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    own = posts.join(many, "at").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = own.select("at", "key", "n", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("at", "key", "n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    x, y = cells.alias("x"), cells.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("at", "i", "j")]
    fit = (F.col("x.n") >= F.col("y.n") * similarity) & (F.col("y.n") >= F.col("x.n") * similarity)
    other = (F.col("x.i") == F.col("x.j")) | (F.col("x.own") != F.col("y.own"))
    return x.join(y, same[0] & same[1] & same[2] & (F.col("x.key") < F.col("y.key")) & fit & other).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def candidates(reps: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, distinct: pairs that collide as often as the prefix asks for."""
    t = fewest(COORDINATES, similarity**2)
    need = min(2, t)
    met = written(merged(_postings(reps, COORDINATES - t + need), similarity, hot))
    counted = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("hits"))
    skipped = met.where("b is null").select("a", "at", "n")
    out = counted.where(F.col("hits") >= need).select("a", "b")
    if skipped.isEmpty():
        return out
    if need > 1:  # one collision here, and another in a list that both were skipped in
        single = counted.where("hits = 1")
        some = skipped.select("a").distinct()
        for side in "ab":
            single = single.join(some.select(F.col("a").alias(side)), side, "left_semi")
        out = out.unionByName(single.select("a", "b"))
    return out.unionByName(skipped_pairs(skipped, similarity, need > 1, hot)).distinct()


def _both(pairs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(found.select(F.col("key").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def similar_classes(found: DataFrame, reps: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b, similarity): pairs of class representatives, a < b, that reach the similarity. ``found``: written features by key; ``reps``: those of representatives."""
    kind = dict(found.dtypes)["key"]
    least, match = fewest(MINIMA, similarity), fewest(COORDINATES, similarity**2)
    pairs = candidates(reps, similarity, hot)

    def near(x: dict[str, list]) -> dict[str, list]:
        if not x["a"]:
            return {"a": [], "b": []}
        s, t = (np.frombuffer(b"".join(x["sketch_" + side]), np.uint8).reshape(-1, MINIMA) for side in "ab")
        agree = s == t
        kept = np.nonzero((agree.sum(axis=1) >= least) & ((agree[:, 0::2] & agree[:, 1::2]).sum(axis=1) >= match))[0].tolist()
        return {side: [x[side][k] for k in kept] for side in "ab"}

    def exact(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": [], "similarity": []}
        for a, b, p, q in zip(x["a"], x["b"], x["own_a"], x["own_b"], strict=True):
            p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
            both = len(np.intersect1d(p, q))
            if (share := both / (len(p) + len(q) - both)) >= similarity:
                for k, v in (("a", a), ("b", b), ("similarity", share)):
                    out[k].append(v)
        return out

    likely = map_rows(_both(pairs, found, "sketch"), near, f"a {kind}, b {kind}", rows=5000)
    return map_rows(_both(likely, found, "own"), exact, f"a {kind}, b {kind}, similarity double", rows=200)


def near_copies(feats: DataFrame, similarity: float, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives, membership). Membership: (key, rep) of every key that has shingles.

    Rows with a null key are left out; of several rows with one key the one whose set has the greatest hash counts. Both results
    rest on written tables.
    """
    columns = ["same", "n", "at", "sketch", "own"]
    one = feats.where("key is not null").groupBy("key").agg(F.max_by(F.struct(*columns), "same").alias("x"))
    found = written(one.select("key", "x.*"), by="key")
    heads = found.groupBy("same").agg(F.min("key").alias("rep"))
    members = found.select("same", "key").join(heads, "same").select("key", "rep")
    reps = found.join(heads.select(F.col("rep").alias("key")), "key", "left_semi")
    return written(similar_classes(found, reps, similarity, hot)), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of keys of similar or equal classes. As large as its result has to be; large classes are paired block by block."""
    members = written(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").select("rep", F.ceil(F.col("size") / HOT).cast("int").alias("blocks"))
    many = members.join(sizes, "rep")
    m = many.select("rep", "key", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    o = many.select(F.col("rep").alias("r"), F.col("key").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    within = m.join(o, (F.col("rep") == F.col("r")) & (F.col("block") == F.col("k")) & (F.col("key") < F.col("b"))).select(F.col("key").alias("a"), "b")
    x = pairs.join(members.select(F.col("rep").alias("a"), F.col("key").alias("one")), "a").join(members.select(F.col("rep").alias("b"), F.col("key").alias("two")), "b")
    across = x.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).where("a < b")
    return within.unionByName(across)


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, group, links): of each key the smallest key that it is linked to over any chain of pairs, and its number of similar other keys.

    Smallest labels spread along pairs, with jumps to the label's own label, until none changes: rounds grow as the
    logarithm of the longest chain. Each round is written.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    edges = cut_lineage(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = cut_lineage(sizes.select(F.col("rep").alias("v"), F.col("rep").alias("l")))
    while True:
        near = edges.join(label, edges.b == label.v).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label.v == near.a, "left").select("v", "l", F.least("l", F.coalesce("m", "l")).alias("x"))
        up = label.select(F.col("v").alias("x"), F.col("l").alias("up"))
        new = cut_lineage(step.join(up, "x", "left").select("v", "l", F.least("x", F.coalesce("up", "x")).alias("x")))
        done = new.where("l <> x").isEmpty()
        label = new.select("v", F.col("x").alias("l"))
        if done:
            break
    others = edges.join(sizes, edges.b == sizes.rep).groupBy("a").agg(F.sum("size").alias("other"))
    of = sizes.join(label, sizes.rep == label.v).join(others, F.col("rep") == others.a, "left")
    of = of.select("rep", F.col("l").alias("group"), (F.col("size") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    return members.join(of, "rep").select("key", "group", "links")


def with_single(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, group, links) of every key of ``rows``: those without shingles, that are like no other, are a group of their own. Null keys drop out."""
    every = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    return every.join(found, "key", "left").select("key", F.coalesce("group", "key").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def text_features(texts: DataFrame, key: str, text: str, width: int = 5, short: bool = False) -> DataFrame:
    """Features of plain texts; with ``short`` also of those of fewer words than ``width``."""
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return features(rows, lambda x: [shingles(t, width, short) for t in x["text"]], dict(texts.dtypes)[key])
