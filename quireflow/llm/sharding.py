"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.sources.scratch import materialize


#: Source partitions at most, so that the matrix stays small for any corpus.
MOST_PARTS = 1 << 14


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of `draws` taken without replacement from `total` are among the `good`, by inversion from the mode outwards."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    left, u = rng.random() - at_mode, mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            left -= p_up
            u = up
        if left > 0 and down > low:
            p_down *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            u = down
    return u


def communication_matrix(sizes: list[tuple[int, int]], n_shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Rows (part, shard, first rank, end rank): how many rows each source partition sends to each shard.

    The shard sizes are fixed first and differ by one at most; the counts are drawn from the
    multivariate hypergeometric law with those margins, as a uniform permutation would give.
    """
    total = sum(n for _, n in sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for part, n in sorted(sizes):
        rng = random.Random(f"{seed}:{part}")
        at, left, free = 0, n, sum(room)
        for s in range(n_shards):
            k = hypergeometric(rng, room[s], free, left)
            free -= room[s]
            room[s] -= k
            left -= k
            if k:
                out.append((part, s, at, at + k))
            at += k
    return out


def shuffle_shards(docs: DataFrame, n_shards: int = 8, seed: int = 42, key: str = "doc_id", tiebreak: str | None = None, rows_per_part: int = 1 << 16) -> DataFrame:
    """Add shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) to every row of docs.

    The rows form a uniform random permutation and shard sizes differ by one at most. Steps: rows
    are dealt to logical source partitions by a hash of their key; only the partitions' counts
    (one number for each `rows_per_part` rows) go to the driver, which draws the partition-to-
    shard matrix; each partition is permuted on its own and cut by its row of the matrix; after
    the exchange each shard is permuted again, in ranges of a random number, so no task holds a
    whole shard. Ordering is by hashes of key and tiebreak, hence a lost task is redone alike.

    Rows are numbered by their place in the input and written once, so that rows with equal keys
    (also null keys) and tiebreaks, or wholly equal rows, are spread like any other. A partition
    has rows_per_part rows, more where that would make over MOST_PARTS partitions. An empty table
    gives an empty result. All other columns are carried along, but for columns named shard and
    slot, which are replaced; `__row`, `__part`, `__order`, `__rank` and `__cut` are used inside.
    """
    spark = docs.sparkSession
    parts_key = [F.col(c) for c in ([key, tiebreak, "__row"] if tiebreak else [key, "__row"])]
    numbered = materialize(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    total = numbered.count()
    n_parts = min(max(16, math.ceil(total / rows_per_part)), MOST_PARTS)
    base = numbered.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), *parts_key), F.lit(n_parts)).cast("int"))
    sizes = [(r["__part"], r["count"]) for r in base.groupBy("__part").count().collect()]
    plan = communication_matrix(sizes, n_shards, seed)
    literal = F.from_json(F.lit(json.dumps([dict(p=p, s=s, e=e) for p, s, _, e in plan])), "array<struct<p:int,s:int,e:bigint>>")
    cuts = spark.range(1).select(F.inline(literal)).toDF("__part", "shard", "__end")

    local = Window.partitionBy("__part").orderBy("__order", *parts_key)
    ranked = base.withColumn("__order", F.xxhash64(F.lit(seed + 1), *parts_key)).withColumn("__rank", F.row_number().over(local) - 1)
    rows_of = cuts.groupBy("__part").agg(F.sort_array(F.collect_list(F.struct(F.col("__end").alias("end"), "shard"))).alias("__cut"))
    sent = (
        ranked.join(rows_of, "__part")
        .withColumn("shard", F.filter("__cut", lambda c: c["end"] > F.col("__rank"))[0]["shard"])
        .withColumn("__order", F.xxhash64(F.lit(seed + 2), *parts_key))
        .withColumn("__cell", F.pmod(F.shiftright("__order", 20), F.lit(max(16, n_parts // n_shards))).cast("int"))
        .drop("__part", "__rank", "__cut")
    )
    sent = materialize(sent, "exchanged")
    cells = sent.groupBy("shard", "__cell").count()
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("shard", "__cell").orderBy("__order", *parts_key)
    return (
        sent.withColumn("__rank", F.row_number().over(inner) - 1)
        .join(offsets, ["shard", "__cell"])
        .withColumn("slot", (F.col("__base") + F.col("__rank")).cast("long"))
        .drop("__cell", "__order", "__rank", "__base", "__row")
    )
