"""Connected components of an edge table, by alternating star contraction on the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (a long, b long): root is the least node of its component.

    Each round hangs the larger neighbours of every node on its least neighbour (large star), then the
    smaller ones (small star). Both are an aggregate and a join, so a node with a third of all edges is
    summed before the shuffle and its join partition can be split. Rounds grow with the logarithm of
    the longest path; edges never grow in number."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct(), "edges")
        # done when every node hangs on one root only and no root hangs on another
        deep = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
        unfinished = deep.where("n > 1").select("a").union(now.select(F.col("b").alias("a")).distinct().join(deep, "a", "left_semi"))
        if unfinished.isEmpty():
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
