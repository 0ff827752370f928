"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows of a partition that `dealt` aims at.
ROWS = 1 << 17


def session(master: str = "local[*]", app: str = "quireflow", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str | Column, rows: int | None = None) -> DataFrame:
    """df dealt by keys to as many partitions of about `rows` (ROWS) rows as it needs, so that a task's sorts and hash maps don't grow with it; for tables whose rows are counted without reading columns."""
    return df.repartition(max(1, -(-df.count() // (rows or ROWS))), *keys)
