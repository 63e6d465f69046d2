"""Values handed on within a session: named views instead of stored JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def remember(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def recall(spark: SparkSession, name: str) -> DataFrame | None:
    """The remembered table, or nothing."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def forget(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)
