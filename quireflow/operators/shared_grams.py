"""How many of given texts' character grams every document has, counted inside one scan for each shard of grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.scratch import materialize

#: Grams that a scan looks for at once: 8 bytes each for a hash and 4 for every character.
SHARD = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n code points."""
    size = max(len(points) - n + 1, 0)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE) + points[k : k + size].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Grams:
    """Wanted grams of n characters by hash, with their characters, and the items that have each."""

    def __init__(self, rows: list[tuple[str, list[int]]], n: int):
        self.n = n
        points = np.array([code_points(g) for g, _ in rows], dtype=np.uint32).reshape(-1, n)
        hashes = np.array([gram_hashes(p, n)[0] for p in points], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.points = hashes[order], points[order]
        sizes = np.array([len(rows[k][1]) for k in order.tolist()], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.items = np.array([i for k in order.tolist() for i in rows[k][1]], dtype=np.int64)

    def shared(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Items and how many of their grams the text has; a hash counts only where the characters agree."""
        p = code_points(text)
        h = gram_hashes(p, self.n) if len(p) >= self.n else p[:0].astype(np.uint64)
        if not len(h) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        found = []
        while len(hit):  # grams with one hash stand side by side
            row = at[hit]
            same = (self.points[row] == p[hit[:, None] + np.arange(self.n)]).all(axis=1)
            found.append(row[same])
            hit = hit[~same]
            at[hit] += 1
            hit = hit[(at[hit] < len(self.hashes))]
            hit = hit[self.hashes[at[hit]] == h[hit]]
        rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        take = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(take)
        own = self.items[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - take), take)]
        return np.unique(own, return_counts=True)


def shared_grams(docs: DataFrame, wanted: DataFrame, n: int, key: str = "doc_id", text: str = "text", item: str = "item_id", shard: int = SHARD) -> DataFrame:
    """item, key, shared: for each document the number of distinct grams that it shares with an item, 1 or more. wanted: item, g (grams of n characters).

    Wanted grams are dealt by hash to shards of about `shard`, each broadcast for a scan of its
    own, and counts of the shards are added up; documents' grams never become rows. Keys and items
    are whole numbers; null texts have no grams.
    """
    spark = docs.sparkSession
    per_gram = wanted.groupBy("g").agg(F.collect_set(F.col(item).cast("long")).alias("items"))
    stored = materialize(per_gram, "wanted")
    shards = -(-stored.count() // shard) or 1
    placed = stored.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    src = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())

    def scan(own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = Grams(own.value, n)
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    items, counts = grams.shared(t)
                    if len(items):
                        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.full(len(items), k, np.int64)), pa.array(counts)], names=["item", "__key", "shared"])

        return src.mapInArrow(run, "item long, __key long, shared long")

    parts = [spark.sparkContext.broadcast([(r.g, r["items"]) for r in placed.where(F.col("shard") == k).collect()]) for k in range(shards)]  # one shard at a time
    found = reduce(DataFrame.unionByName, map(scan, parts))
    found = found if shards == 1 else found.groupBy("item", "__key").agg(F.sum("shared").alias("shared"))
    return found.select(F.col("item").alias(item), F.col("__key").alias(key), "shared")
