"""Near 64-bit hashes by multi-index tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS, WIDTH = 4, 16


def sign_hash(vector: Column, order: list[int] | None = None) -> Column:
    """The signs of a 64-dimension vector, its places taken in `order`, as a signed long."""
    bits = [F.when(F.element_at(vector, i + 1) > 0, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for k, i in enumerate(order or range(64))]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def flips(vector: Column) -> Column:
    """Hashes of an 8 by 8 picture as it stands, mirrored, and upside down."""
    rows = range(8)
    return F.array(sign_hash(vector), sign_hash(vector, [8 * r + 7 - c for r in rows for c in rows]), sign_hash(vector, [8 * (7 - r) + c for r in rows for c in rows]))


def _masks(radius: int) -> list[int]:
    """All ways to change up to `radius` bits of a band."""
    return [sum(1 << i for i in places) for n in range(radius + 1) for places in combinations(range(WIDTH), n)]


def _keys(df: DataFrame, hashes: str, radius: int) -> DataFrame:
    """A row for each variant, band and way to change the band's bits: k (band), v (its changed bits), h (the whole hash)."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius)])
    bands = F.array(*[F.lit(k) for k in range(BANDS)])
    each = df.select("*", F.explode(F.array_distinct(hashes)).alias("__h")).select("*", F.explode(bands).alias("__k"))
    value = F.call_function("shiftrightunsigned", F.col("__h"), F.col("__k") * WIDTH).bitwiseAND((1 << WIDTH) - 1)
    return each.withColumn("__v", value).select("*", F.explode(F.transform(masks, lambda m: F.col("__v").bitwiseXOR(m))).alias("__key")).drop("__v", hashes)


def hamming_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """a, b and the least distance over their variants, at `most` differing bits or fewer; left (a, ha), right (b, hb) with arrays of hashes.

    Exact: of four bands of 16 bits one differs in at most `most // 4` bits. Half of these are
    changed on the left and the rest on the right, so that both sides come to the same value; an
    equality join on it finds all pairs, and distances are taken of the whole hashes. Sides are
    merged: a row becomes hundreds of keys, which Spark's estimates for a broadcast don't count.
    """
    radius = most // BANDS
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = _keys(left.select("a", "ha").repartition(n, "a"), "ha", radius // 2).withColumnRenamed("__h", "x")
    y = _keys(right.select("b", "hb").repartition(n, "b"), "hb", radius - radius // 2).withColumnRenamed("__h", "y")
    near = x.hint("merge").join(y, ["__k", "__key"]).withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))
    return near.where((F.col("distance") <= most) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.min("distance").alias("distance"))
