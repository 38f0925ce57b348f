"""Token ids of a public byte-level BPE vocabulary, and their text, by SQL in DuckDB within each partition.

A text is parted into words by the vocabulary's pattern. The distinct words of a batch that are not yet known become
rows (word, position, token), one for each byte. A recursive query joins neighbouring rows with the merge table and in
each round contracts the pair of least rank in every word, wherever it stands, from the left and without overlap, until no word has a pair: a pair
that a contraction makes always has a greater rank, so that is the order of one contraction at a time. The query keeps only the
latest state of a word, so a long word without blanks takes the same way as a short one. Ordered aggregation then gives each word's
ids, and the words of a text are put together. The words that a worker knows are kept, up to a bound.

Ids become text by a join with the vocabulary's bytes and ordered aggregation.

The vocabulary file is read once on the driver and sent along; workers need no copy of it.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_rows, spread

KNOWN = 1 << 18
ROUND = 1 << 18  # bytes of new words, or those of one longer word, that are contracted together
ROWS = 4096
FOLDER = os.environ.get("LINKLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the vocabulary parts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTRACT = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM start
    UNION
    SELECT w, pos, CASE WHEN taken_before THEN -1 WHEN taken THEN made ELSE tok END
    FROM (
        SELECT *, coalesce(lag(taken) OVER own, false) AS taken_before
        FROM (
            SELECT *, best IS NOT NULL AND rank IS NOT DISTINCT FROM best AND (nth - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN nth END) OVER own, 0)) % 2 = 1 AS taken
            FROM (
                SELECT *, min(rank) OVER (PARTITION BY w) AS best
                FROM (SELECT s.w, s.pos, s.tok, s.nth, m.made, m.rank
                    FROM (SELECT w, pos, tok, lead(tok) OVER own AS next, row_number() OVER own AS nth FROM recurring.state WHERE tok >= 0 AND w IN (SELECT w FROM state) WINDOW own AS (PARTITION BY w ORDER BY pos)) s
                    LEFT JOIN merges m ON (s.tok::BIGINT << 20 | s.next) = m.pair)
            )
            WHERE best IS NOT NULL
            WINDOW own AS (PARTITION BY w ORDER BY pos)
        )
        WINDOW own AS (PARTITION BY w ORDER BY pos)
    )
    WHERE taken OR taken_before
)
SELECT w, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY w
"""

DECODE = """
SELECT k, string_agg(hex, '' ORDER BY i) AS hex, count(hex) AS known, count(*) AS every
FROM (SELECT k, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM given_ids) g LEFT JOIN pieces p ON g.id = p.id GROUP BY k
"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """``file``: the vocabulary file's content."""

    def __init__(self, file: bytes):
        import duckdb
        import regex

        model = json.loads(file)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({"pair": pa.array([vocab[x] << 20 | vocab[y] for x, y in pairs], pa.int64()), "made": pa.array([vocab[x + y] for x, y in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int64())})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        pieces = {i: bytes(letters[c] for c in word).hex() for word, i in vocab.items() if all(c in letters for c in word)}
        pieces |= {x["id"]: x["content"].encode().hex() for x in json.loads(file).get("added_tokens", [])}
        self.db.register("given_pieces", pa.table({"id": pa.array(list(pieces), pa.int64()), "hex": pa.array(list(pieces.values()))}))
        self.db.execute("CREATE TABLE pieces AS SELECT * FROM given_pieces")
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # number of a word; its ids are flat[first : first + size]
        self.first, self.size, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32))

    def learn(self, words: list[str]) -> None:
        """Ids of new words, by the recursive query."""
        raw = [w.encode("utf-8", "replace") for w in words]
        begin, total = 0, 0
        for k, b in enumerate(raw):
            if total and total + len(b) > ROUND:
                self._contract(words[begin:k], raw[begin:k])
                begin, total = k, 0
            total += len(b)
        self._contract(words[begin:], raw[begin:])

    def _contract(self, words: list[str], raw: list[bytes]) -> None:
        sizes = np.array([len(b) for b in raw])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        rows = pa.table({"w": pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), sizes)), "pos": pa.array((np.arange(len(tok)) - first).astype(np.int32)), "tok": pa.array(tok)})
        self.db.register("start", rows)
        out = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        lists = out["ids"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        self._keep([words[w] for w in out["w"].to_pylist()], size, lists.values.to_numpy()[lists.offsets[0].as_py() :])

    def _keep(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        for n, w in enumerate(words, len(self.known)):
            self.known[w] = n
        self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids)

    def part(self, texts: list[str | None]) -> tuple:
        """Numbers of the words of all texts one after the other, and the number of words of each text."""
        parted = [self.find(t) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.forget()
        known = self.known
        if new := list({w for p in parted for w in p if w not in known}):
            self.learn(new)
        return np.array([known[w] for p in parted for w in p], np.int64), np.array([len(p) for p in parted], np.int64)

    def counts(self, texts: list[str | None]):
        """Number of ids of each text."""
        words, many = self.part(texts)
        total = np.append(0, np.cumsum(self.size[words]))
        ends = np.cumsum(many)
        return total[ends] - total[ends - many]

    def arrow(self, texts: list[str | None]):
        """Ids of each text as an Arrow list array."""
        words, many = self.part(texts)
        size = self.size[words]
        total = np.append(0, np.cumsum(size))
        if total[-1] >= 1 << 31:
            raise ValueError("more ids in a batch than a list array can number")
        at = np.repeat(self.first[words] - total[:-1], size) + np.arange(total[-1])
        offsets = np.append(0, total[np.cumsum(many)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.flat[at]))

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """Texts of lists of ids; null where an id is null or not in the vocabulary. A null or empty list is an empty text; bytes that are no UTF-8 become U+FFFD."""
        out: list[str | None] = [""] * len(ids)
        some = [k for k, x in enumerate(ids) if x]
        self.db.register("given_ids", pa.table({"k": pa.array(some, pa.int64()), "ids": pa.array([ids[k] for k in some], pa.list_(pa.int64()))}))
        for k, hexed, known, every in self.db.sql(DECODE).fetchall():
            out[k] = bytes.fromhex(hexed).decode("utf-8", "replace") if known == every else None
        self.db.unregister("given_ids")
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.arrow(texts).to_pylist()


@lru_cache(2)
def encoder(file: bytes) -> Encoder:
    return Encoder(file)


def _vocabulary(rows: DataFrame, vocabulary: str | None) -> Broadcast[bytes]:
    """The vocabulary file, some MB at any size of the input, for all workers."""
    return rows.sparkSession.sparkContext.broadcast(Path(vocabulary or f"{FOLDER}/byte_bpe_50k.json").read_bytes())


def token_ids(texts: DataFrame, key: str, text: str, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """One row (key, ids) for each row of the input, without special tokens; their strings are ordinary text.

    Null and empty texts get an empty list. Texts are encoded whole. ``vocabulary``: path of a vocabulary file with merges, on the driver.
    """
    file, kind = _vocabulary(texts, vocabulary), dict(texts.dtypes)[key]
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    out = map_rows(rows, lambda x: {"key": x["key"], "ids": encoder(file.value).arrow(x["text"])}, f"key {kind}, ids array<int>", ROWS)
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids))


def token_counts(texts: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """One row (key, n_tokens) for each row of the input; 0 for null and empty texts."""
    file, kind = _vocabulary(texts, vocabulary), dict(texts.dtypes)[key]
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    out = map_rows(rows, lambda x: {"key": x["key"], "n_tokens": encoder(file.value).counts(x["text"]).tolist()}, f"key {kind}, n_tokens bigint", ROWS)
    return out.withColumnRenamed("key", key)


def texts_of(encoded: DataFrame, key: str, ids: str = "ids", vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """One row (key, text) for each row of the input: what the ids stand for. Null and empty lists give an empty text; a list with a null or unknown id gives null."""
    file, kind = _vocabulary(encoded, vocabulary), dict(encoded.dtypes)[key]
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<bigint>").alias("ids"))
    out = map_rows(rows, lambda x: {"key": x["key"], "text": encoder(file.value).decode(x["ids"])}, f"key {kind}, text string", ROWS)
    return out.select(F.col("key").alias(key), F.col("text").alias(text))
