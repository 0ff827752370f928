"""Exact similarity self-join of vectors, pruned by angles to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.scratch import materialize

PIVOTS = 32
#: Neighbouring blocks that are sent to a task together.
TILE = 16


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of the rows that have a vector other than zero; lengths must agree."""
    keys, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    some = [k for k, v in enumerate(vectors) if v is not None]
    rows = np.array([vectors[k] for k in some], dtype=np.float64) if some else np.zeros((0, 1))
    size = np.linalg.norm(rows, axis=1)
    return keys[some][size > 0], rows[size > 0] / size[size > 0, None]


def vector_blocks(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """block, cell, n, low, high, ids, data: unit vectors in blocks of at most `rows`, near ones together, with the least and greatest angle to each pivot.

    Vectors go to the nearest of PIVOTS pivots (the rows with the smallest hashes of their keys) and
    lie within it in order of their angle to it; sorting is by range over all partitions.
    """
    src = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    picked = src.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(PIVOTS)
    pivots = _unit(pa.RecordBatch.from_pandas(picked.toPandas(), schema=pa.schema([("key", pa.int64()), ("vector", pa.list_(pa.float64()))])))[1]  # PIVOTS rows
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "block long, cell int, n long, low array<double>, high array<double>, ids binary, data binary")
    width = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, unit = _unit(batch)
            if not len(keys):
                continue
            angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            cell = angles.argmin(axis=1)
            data = [v.tobytes() for v in unit]
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(cell.astype(np.int32)), pa.array(angles.min(axis=1)), pa.array(data, pa.binary())], names=["key", "cell", "angle", "data"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            unit = np.frombuffer(b"".join(data), dtype=np.float64).reshape(-1, width)
            angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            return pa.RecordBatch.from_pylist([{"cell": now, "n": len(ids), "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(), "ids": np.array(ids, dtype=np.int64).tobytes(), "data": unit.tobytes()}], shape)

        shape = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("data", pa.binary())])
        now, ids, data = None, [], []
        for batch in batches:
            for k, c, d in zip(batch.column("key").to_pylist(), batch.column("cell").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if ids and (c != now or len(ids) == rows):
                    yield made()
                    ids, data = [], []
                now = c
                ids.append(k)
                data.append(d)
        if ids:
            yield made()

    placed = src.mapInArrow(place, "key long, cell int, angle double, data binary").orderBy("cell", "angle", "key")
    made = placed.mapInArrow(block, "cell int, n long, low array<double>, high array<double>, ids binary, data binary")
    return materialize(made.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def block_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """i, j, products: pairs of blocks (i <= j) that can hold vectors at a cosine of `least`, by the triangle inequality of angles.

    For each pivot the angles of two such vectors differ by arccos(least) at most. Blocks meet by an
    equality join on pairs of cells, of which there are a fixed number.
    """
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-7
    side = blocks.select("block", "cell", "n", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(PIVOTS - 1))).alias("other"))
    side = side.select("block", "n", "low", "high", F.least("cell", "other").alias("p"), F.greatest("cell", "other").alias("q"), (F.col("cell") <= F.col("other")).alias("first"), (F.col("cell") >= F.col("other")).alias("second"))
    name = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("block", "n", "low", "high")]
    both = side.where("first").select("p", "q", *name("a")).join(side.where("second").select("p", "q", *name("b")), ["p", "q"])
    apart = F.exists(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda x: F.greatest(x["a_low"] - x["b_high"], x["b_low"] - x["a_high"]) > reach)
    own = (F.col("p") < F.col("q")) | (F.col("a_block") <= F.col("b_block"))
    products = F.when(F.col("a_block") == F.col("b_block"), F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
    return both.where(own & ~apart).select(F.col("a_block").alias("i"), F.col("b_block").alias("j"), products.alias("products"))


def tiles(blocks: DataFrame, least: float, most: int = TILE) -> DataFrame:
    """tile, block, others: each block once for each tile that needs it, with the blocks there that it is multiplied with.

    A tile is the pairs of two groups of at most `most` neighbouring blocks, so that a block is sent to
    a task once for `most` products, and a task holds 2 * `most` blocks at a time.
    """
    pairs = block_pairs(blocks, least)
    width = max(1, min(most, blocks.count() // 16))
    place = blocks.select("block", F.expr(f"(row_number() OVER (ORDER BY block) - 1) div {width}").alias("g"))  # one short row for each block
    for c in "ij":
        pairs = pairs.join(place.toDF(c, f"g_{c}"), c)
    placed = pairs.select(F.struct("g_i", "g_j").alias("tile"), "i", "j")
    each = placed.select("tile", F.col("i").alias("block"), F.col("j").alias("other")).unionByName(placed.select("tile", F.col("j").alias("block"), F.lit(None).cast("long").alias("other")))
    return each.groupBy("tile", "block").agg(F.collect_list("other").alias("others")).select(F.xxhash64("tile").alias("tile"), "block", "others")


def similarity_join(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", rows: int = 2048) -> DataFrame:
    """a, b, cosine of all vectors (a < b) at a cosine of `least` or more, exactly; least is above 0.

    Vectors are sorted into blocks of near ones; pairs of blocks that no vector pair can lie in are
    left out, and of the others each is one product of matrices. Null and zero vectors are similar
    to none. What is computed falls as `least` rises (block_pairs tells how much).
    """
    blocks = vector_blocks(vectors, key, vector, rows)

    def products(own: list[dict]) -> Iterator[pa.RecordBatch]:
        at = {r["block"]: (np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["data"], dtype=np.float64).reshape(r["n"], -1)) for r in own}
        for i, j in ((r["block"], j) for r in own for j in r["others"]):
            (p, x), (q, y) = at[i], at[j]
            for start in range(0, len(x), 256):
                sim = x[start : start + 256] @ y.T
                u, v = np.nonzero(sim >= least - 1e-9)
                kept = start + u < v if i == j else np.ones(len(u), bool)
                a, b, cosine = p[start + u[kept]], q[v[kept]], sim[u[kept], v[kept]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine)], names=["a", "b", "cosine"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["tile"] != now:
                    yield from products(own)
                    now, own = row["tile"], []
                own.append(row)
        yield from products(own)

    sent = tiles(blocks, least).join(blocks.select("block", "n", "ids", "data"), "block")
    return sent.repartition("tile").sortWithinPartitions("tile").mapInArrow(multiply, "a long, b long, cosine double")
