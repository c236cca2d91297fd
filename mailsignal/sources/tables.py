"""Parquet table scans. Column pruning and filter pushdown are left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it is split on disk. A session may ask for another number of partitions with
    ``spark.mailsignal.scanPartitions`` (the local sessions of tests and bench do: their tables are one row
    group each); it is a setting, never derived from the data."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    wanted = spark.conf.get("spark.mailsignal.scanPartitions", None)
    return df.repartition(int(wanted)) if wanted else df
