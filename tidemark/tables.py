"""The driver's tables as DataFrames and, for SQL text, as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark's Parquet reader, so column pruning and filter push-down apply."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables. Only schemas are read here."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
