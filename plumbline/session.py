"""Session factory and table reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, adaptive execution, Arrow, RocksDB state. A cluster's own settings stay."""
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(app).config(map=wanted | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
