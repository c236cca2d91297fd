"""Exact row numbers without a window over a hot partition key.

``row_number() over (partition by label order by h)`` sends every row of a class
to one task. Here rows are range-partitioned on (group, order keys), numbered
inside each partition with ``monotonically_increasing_id`` after a local sort,
and shifted by the row counts of the earlier partitions of the same group (a
table of at most partitions x groups rows). The order keys must be total (end
with a unique id) so the result is deterministic and survives task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.session import ensure_checkpoint_dir


def seeded_hash(seed: int, id_col: str) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed|id' (same text in SQL engines)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def rank_within(df: DataFrame, group_col: str | None, order_cols: list[str], rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``rank_col``: position of the row inside its group in ``order_cols`` order.
    ``order_cols[-1]`` must be a unique row id. Only the key columns are ranked; the numbered
    keys are checkpointed (shared checkpoint folder) so the per-partition counts and the rows
    come from one materialisation, then joined back on the id."""
    id_col = order_cols[-1]
    src = df if group_col else df.withColumn("_g", F.lit(0))
    ranks = rank_keys(src, group_col or "_g", order_cols, rank_col, num_partitions).select(id_col, rank_col)
    out = src.join(ranks, id_col, "inner")
    return out if group_col else out.drop("_g")


def rank_keys(src: DataFrame, g: str, order_cols: list[str], rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """The ranked keys alone: group, order columns and ``rank_col``, checkpointed."""
    spark = src.sparkSession
    keys = [g] + order_cols
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = (src.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ensure_checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    stats = r.groupBy("_pid", g).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    s = stats.select(F.col("_pid").alias("_spid"), F.col(g).alias("_sg"), "_off", "_first")
    return (r.join(s, (F.col("_pid") == F.col("_spid")) & F.col(g).eqNullSafe(F.col("_sg")), "inner")
            .select(*keys, (F.col("_off") + F.col("_local") - F.col("_first")).cast("bigint").alias(rank_col)))


def running_sum(df: DataFrame, group_col: str, order_cols: list[str], value_col: str, out_col: str,
                inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Cumulative sum of ``value_col`` within ``group_col`` in ``order_cols`` order (exclusive by default).
    Range-partitioned like ``rank_within``: each task sums one range partition, earlier partitions of the
    same group contribute an offset from a small per-partition table. The partitioned input is
    checkpointed so both uses see the same partition numbers."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group_col] + order_cols
    ensure_checkpoint_dir(spark)
    r = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    local = Window.partitionBy("_pid", group_col).orderBy(*order_cols).rowsBetween(*frame)
    r = r.withColumn("_local", F.coalesce(F.sum(value_col).over(local), F.lit(0)))
    stats = r.groupBy("_pid", group_col).agg(F.sum(value_col).alias("_tot"))
    w = Window.partitionBy(group_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_tot").over(w), F.lit(0)))
    s = stats.select(F.col("_pid").alias("_spid"), F.col(group_col).alias("_sg"), "_off")
    out = r.join(s, (F.col("_pid") == F.col("_spid")) & F.col(group_col).eqNullSafe(F.col("_sg")), "inner")
    return out.withColumn(out_col, F.col("_off") + F.col("_local")).drop("_pid", "_spid", "_sg", "_local", "_off")
