"""Tables that micro-batches write by epoch: a batch applied twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quireflow.sources.scratch import children


class EpochTable:
    """Rows below one folder, each epoch in a folder of its own that a repeated epoch replaces.

    With keys the table is a keyed merge: of a key the row of the last epoch holds, so an upsert
    writes the batch's rows only. Every `every` epochs the merged rows are written as a base, so a
    read merges that base and fewer than `every` batches, however long the stream has run. An epoch's
    rows have each key once. Without keys rows are appended.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: tuple[str, ...] = (), every: int = 16):
        self.spark, self.root, self.keys, self.every = spark, root.rstrip("/"), keys, every
        self.columns = schema.names
        self.schema = StructType([*schema.fields, StructField("__epoch", LongType())])

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.select(*self.columns, F.lit(epoch).cast("long").alias("__epoch")).write.mode("overwrite").parquet(f"{self.root}/batch={epoch}")
        if self.keys and (epoch + 1) % self.every == 0:
            self._merged(epoch + 1).write.mode("overwrite").parquet(f"{self.root}/base={epoch}")

    def _stored(self, before: int | None) -> DataFrame:
        names = [n.split("=") for n in children(self.spark, self.root)]
        found = [(kind, int(n)) for kind, n in names if before is None or int(n) < before - (kind == "base")]
        base = max((n for kind, n in found if kind == "base"), default=-1)
        paths = [f"{self.root}/{kind}={n}" for kind, n in found if n > base or (kind, n) == ("base", base)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _merged(self, before: int | None) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        last = self._stored(before).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__epoch").alias("last"))
        return last.select(*self.keys, "last.*")

    def rows(self, before: int | None = None) -> DataFrame:
        """What holds after all epochs, or after those before `before`."""
        return (self._merged(before) if self.keys else self._stored(before)).select(*self.columns)
