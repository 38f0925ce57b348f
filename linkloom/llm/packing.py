"""Filling containers of fixed capacity: shortest-pack-first over the histogram of lengths.

The driver sees only how many items there are of each length, at most ``capacity`` numbers. Lengths are placed from the
longest on. An item goes to the emptiest open pack that it fits; packs of equal make-up are one pattern with a count, so
whole counts are placed at once. Items then find their pack by their rank among the items of their length: each pattern
takes an interval of the ranks. Ranks come from counts by length and hash bucket and the order within a bucket, so that a
length that a third of all items have is not numbered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut_lineage

BUCKETS = 256  # at least; twice the cores where these are more
CONTAINERS = 100

Pattern = tuple[tuple[int, int], ...]


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(count, ((length, copies), ...)) of all packs. Lengths are 1 to capacity; others are an error."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("a length is outside 1 to capacity")
    packs: dict[int, dict[Pattern, int]] = {}  # by the room left

    def put(room: int, pattern: Pattern, count: int) -> None:
        if count:
            at = packs.setdefault(room, {})
            at[pattern] = at.get(pattern, 0) + count

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and (room := max(packs, default=0)) >= size:
            group = packs.pop(room)
            for pattern, count in list(group.items()):
                some = min(count, left)
                put(room - size, (*pattern[:-1], (size, pattern[-1][1] + 1)) if pattern[-1][0] == size else (*pattern, (size, 1)), some)
                put(room, pattern, count - some)
                left -= some
        copies = capacity // size
        put(capacity - size * copies, ((size, copies),), left // copies)
        put(capacity - size * (left % copies), ((size, left % copies),), 1 if left % copies else 0)
    return [(n, p) for room in sorted(packs) for p, n in packs[room].items()]


def intervals(patterns: list[tuple[int, Pattern]]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, copies, first pack), ordered, and the number of packs."""
    at: dict[int, int] = {}
    rows, packs = [], 0
    for count, pattern in patterns:
        for size, copies in pattern:
            rows.append((size, at.get(size, 0), copies, packs))
            at[size] = at.get(size, 0) + copies * count
        packs += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), packs


def fill_containers(items: DataFrame, key: str, length: str, containers: dict[int, int], buckets: int | None = None) -> DataFrame:
    """(container_id, key, piece_no, n_tokens, pack_id) of each piece of each item, for each kind of container.

    ``containers``: capacity by container_id. Only an item longer than the capacity is split: into pieces of the
    capacity, and a last one of the rest. Items of no length take no room: one row with pack_id null; a null length
    counts as none, a negative one as none. Equal keys are items of their own. pack_id counts from 0 in each kind.
    """
    if not 0 < len(containers) <= CONTAINERS or min(containers.values()) <= 0:
        raise ValueError(f"1 to {CONTAINERS} kinds of containers with a capacity above 0 are needed")
    buckets = buckets or max(BUCKETS, 2 * items.sparkSession.sparkContext.defaultParallelism)
    kinds = F.array(*(F.struct(F.lit(k).cast("int").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(containers.items())))
    items = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    each = cut_lineage(items).withColumn("c", F.explode(kinds)).select("key", "n", "c.*")
    pieces = each.select("container_id", "capacity", "key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")) - 1))).alias("piece_no"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("capacity"), F.col("n") - F.col("piece_no") * F.col("capacity")))
    sized = pieces.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece_no"), F.lit(buckets)).cast("int"))
    counts = cut_lineage(sized.groupBy("container_id", "n_tokens", "bucket").agg(F.count("*").alias("many")))
    tables: dict[int, np.ndarray] = {}
    seen: dict[int, dict[int, int]] = {k: {} for k in containers}
    for r in counts.groupBy("container_id", "n_tokens").agg(F.sum("many").alias("many")).collect():  # at most the sum of the capacities
        seen[r["container_id"]][r["n_tokens"]] = r["many"]
    for k, capacity in containers.items():
        tables[k], _ = intervals(pack(seen[k], capacity))
    shared = items.sparkSession.sparkContext.broadcast(tables)  # bounded by capacities and patterns, not by items

    @F.pandas_udf("bigint")
    def pack_of(kind: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(kind), np.int64)
        kind, size, rank = kind.to_numpy(), size.to_numpy().astype(np.int64), rank.to_numpy().astype(np.int64)
        for k in np.unique(kind):
            rows, own = shared.value[int(k)], kind == k
            wide = np.int64(1) << np.int64(44)
            at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], size[own] * wide + rank[own], side="right") - 1
            out[own] = rows[at, 3] + (rank[own] - rows[at, 1]) // rows[at, 2]
        return pd.Series(out)

    before = Window.partitionBy("container_id", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("first", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    within = Window.partitionBy("container_id", "n_tokens", "bucket").orderBy("key", "piece_no")
    ranked = sized.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["container_id", "n_tokens", "bucket"])
    placed = ranked.withColumn("pack_id", pack_of("container_id", "n_tokens", F.col("first") + F.col("nth")))
    none = pieces.where("n_tokens <= 0").withColumn("n_tokens", F.lit(0).cast("bigint")).withColumn("pack_id", F.lit(None).cast("bigint"))
    columns = ["container_id", "key", "piece_no", "n_tokens", "pack_id"]
    return placed.select(columns).unionByName(none.select(columns)).withColumnRenamed("key", key)


def fill_report(placed: DataFrame, containers: dict[int, int]) -> DataFrame:
    """By kind of container: pieces, packs, tokens, the least number of packs that could do, and the share of room used."""
    capacity = F.create_map(*(F.lit(x) for kv in sorted(containers.items()) for x in kv))
    of = placed.where("pack_id is not null").groupBy("container_id").agg(F.count("*").alias("pieces"), (F.max("pack_id") + 1).alias("packs"), F.sum("n_tokens").alias("tokens"))
    room = capacity[F.col("container_id")]
    return of.select("container_id", "pieces", "packs", "tokens", F.ceil(F.col("tokens") / room).alias("least_packs"), (F.col("tokens") / (F.col("packs") * room)).alias("used"))
