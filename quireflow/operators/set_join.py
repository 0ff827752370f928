"""Exact similarity self-join of sets, block by block: a set is sent once for up to BLOCK * GROUP sets that it may be like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.scratch import materialize

#: Sets of a block, a bit of a long each, and neighbouring blocks on either side of a tile.
BLOCK, GROUP = 64, 4
#: Rows of a task: prefix members, and sets sent to tiles.
HEADS, SENT = 1 << 20, 1 << 14
#: Below a threshold by this much nothing is left out before the similarity is rounded to six digits.
SLACK = 1e-6
#: Cells of a part of the matrices that are multiplied.
CELLS = 1 << 22


def place_sets(sets: DataFrame) -> DataFrame:
    """sets (doc_id, n, m, r) with block and slot: sets with the same least member lie next to each other."""
    ordered = sets.select(F.array_min("r").alias("key"), "doc_id", "n", "m", "r").orderBy("key", "doc_id")
    placed = ordered.select(F.monotonically_increasing_id().alias("place"), "doc_id", "n", "m", "r")
    return materialize(placed.select(F.expr(f"place div {BLOCK}").alias("block"), F.expr(f"cast(place % {BLOCK} AS int)").alias("slot"), "doc_id", "n", "m", "r"), "placed")


def tiles(placed: DataFrame, least: float) -> DataFrame:
    """ti, tj (ti <= tj), block, mask: the sets of a block that may be like sets of the other side of a tile of groups of blocks.

    By prefix filtering, which loses none: with members in order of rising frequency, two sets of
    that similarity share one among their first n - ceil(least * n) + 1.
    """
    need = F.ceil(F.col("n") * (least - SLACK) - 1e-9)
    first = placed.where(F.col("m") >= need).select("block", "slot", (F.col("m") - need + 1).cast("int").alias("k"), "r")
    rows = first.agg(F.sum("k")).first()[0] or 0
    head = first.select("block", "slot", F.explode(F.slice("r", F.lit(1), F.col("k"))).alias("s")).repartition(int(rows // HEADS) + 1, "s")
    bits = head.groupBy("s", "block").agg(F.expr("bit_or(shiftleft(1L, slot))").alias("mask"))
    lists = bits.groupBy("s").agg(F.collect_list(F.struct("block", "mask")).alias("l")).where("size(l) > 1 OR bit_count(l[0].mask) > 1")
    met = lists.select("l", F.explode("l").alias("x")).select("x", F.explode("l").alias("y")).where("x.block < y.block OR x.block = y.block AND bit_count(x.mask) > 1")
    met = met.select(F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.col("x.mask").alias("mi"), F.col("y.mask").alias("mj")).groupBy("i", "j").agg(F.bit_or("mi").alias("mi"), F.bit_or("mj").alias("mj"))
    group = [F.expr(f"{c} div {GROUP}").alias(f"t{c}") for c in "ij"]
    each = met.select(*group, F.explode(F.array(F.struct(F.col("i").alias("block"), F.col("mi").alias("mask")), F.struct(F.col("j").alias("block"), F.col("mj").alias("mask")))).alias("e"))
    return materialize(each.groupBy("ti", "tj", F.col("e.block").alias("block")).agg(F.bit_or("e.mask").alias("mask")), "tiles")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many members each set of x shares with each of y, or of x itself where y is None."""
    a, b = (np.concatenate(s) for s in (x, x if y is None else y))
    if y is None:
        members, times = np.unique(a, return_counts=True)
        both = members[times > 1]
    else:
        both = np.intersect1d(a, b)
    found = np.zeros((len(x), len(x if y is None else y)), np.float32)
    wide = max(1, CELLS // max(found.shape))

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = np.flatnonzero(both[at] == flat)
        column, row = at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        return column[order], row[order]

    if not len(both):
        return found
    sides = [(cells(x, a), len(x))] + ([(cells(y, b), len(y))] if y is not None else [])
    for start in range(0, len(both), wide):
        parts = []
        for (column, row), size in sides:
            low, high = np.searchsorted(column, [start, start + wide])
            part = np.zeros((size, min(wide, len(both) - start)), np.float32)
            part[row[low:high], column[low:high] - start] = 1
            parts.append(part)
        found += parts[0] @ parts[-1].T
    return found


def best_rows(k: np.ndarray, na: np.ndarray, nb: np.ndarray, own: np.ndarray, other: np.ndarray, best: int) -> np.ndarray:
    """Places of the rows that can be among the `best` of their `own`, by falling similarity in six digits and rising `other`; rows that rounding could move are all kept."""
    scaled = k / (na + nb - k) * 1e6
    level = np.floor(scaled + 0.5)
    sure = np.abs(scaled - np.floor(scaled) - 0.5) > 1e-4
    at = np.flatnonzero(sure)
    at = at[np.lexsort((other[at], -level[at], own[at]))]
    start = np.r_[True, own[at][1:] != own[at][:-1]] if len(at) else np.zeros(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return np.r_[at[rank < best], np.flatnonzero(~sure)]


def set_pairs(placed: DataFrame, least: float, best: int | None = None) -> DataFrame:
    """a, b, jaccard of placed sets (doc_id, n: all members, r: those that other sets have too) with a similarity of `least` or more.

    Pairs come once with a < b; with `best` both ways, of each a at least its `best` nearest
    (ties by b), so that dense clusters give few rows.
    """
    tiled = tiles(placed, least)
    rows = tiled.agg(F.sum(F.expr("bit_count(mask)"))).first()[0] or 0
    need = F.ceil(F.col("n") * (least - SLACK) - 1e-9)
    sent = tiled.join(placed.where(F.col("m") >= need), "block").where("(mask & shiftleft(1L, slot)) != 0").select("ti", "tj", F.expr(f"block div {GROUP} = ti").alias("first"), "doc_id", "n", "r")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])

    def compare(tile: tuple[int, int], first: list[bool], ids: list[int], sizes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, ids, sizes = np.array(first), np.array(ids, np.int64), np.array(sizes, np.int64)
        alone = tile[0] == tile[1]
        x, y = np.flatnonzero(side), np.flatnonzero(side if alone else ~side)
        if not len(x) or not len(y):
            return
        k = shared_counts([sets[p] for p in x], None if alone else [sets[p] for p in y])
        total = sizes[x][:, None] + sizes[y][None, :]
        near = k >= (least - SLACK) * (total - k) - 1e-6
        u, v = np.nonzero(np.triu(near, 1) if alone else near)
        a, b, shared = x[u], y[v], k[u, v].astype(np.int64)
        if best is None:
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        else:
            a, b, shared = np.r_[a, b], np.r_[b, a], np.r_[shared, shared]
            keep = best_rows(shared, sizes[a], sizes[b], ids[a], ids[b], best)
            a, b, shared = a[keep], b[keep], shared[keep]
        for s in range(0, len(a), 1 << 16):
            e = s + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[s:e]]), pa.array(ids[b[s:e]]), pa.array(shared[s:e]), pa.array(sizes[a[s:e]]), pa.array(sizes[b[s:e]])], schema=shape)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, ([], [], [], [])
        for batch in batches:
            ti, tj, first, ids, sizes = (batch.column(c).to_pylist() for c in range(5))
            lists = batch.column(5)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for p in range(batch.num_rows):
                if (ti[p], tj[p]) != now:
                    if now is not None:
                        yield from compare(now, *own)
                    now, own = (ti[p], tj[p]), ([], [], [], [])
                for kept, value in zip(own, (first[p], ids[p], sizes[p], values[ends[p] : ends[p + 1]].copy()), strict=True):
                    kept.append(value)
        if now is not None:
            yield from compare(now, *own)

    dealt = sent.repartition(int(rows // SENT) + 1, "ti", "tj").sortWithinPartitions("ti", "tj")
    found = dealt.mapInArrow(verify, "a long, b long, k long, na long, nb long")
    return found.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard")).where(F.col("jaccard") >= least)
