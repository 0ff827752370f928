"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the warehouse on a cluster or a new temporary folder in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        local = sc.master.startswith("local[") or sc.master == "local"
        found = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quireflow-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path that a writer has finished (they hold _SUCCESS); none where the path doesn't exist."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(Path(path)):
        return []
    found = [f.getPath() for f in fs.listStatus(Path(path)) if f.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(Path(p, "_SUCCESS")))
