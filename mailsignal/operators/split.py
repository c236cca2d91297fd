"""Sampling, splitting and corpus construction (G1-G7). A null label is a class of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal import lexicon as L
from mailsignal.operators.ranking import rank_keys, rank_within, seeded_hash


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class: one row per class value (bounded by the number of classes)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_class"))


def stratified_split(df: DataFrame, id_col: str, label_col: str = "label", test_size: float = L.TEST_SIZE,
                     seed: int = L.SEED) -> DataFrame:
    """G1: exact per-class hold-out: the first round(test_size * n_class) rows of each class in
    seeded-hash order go to 'test', the rest to 'train'. Only the keys are ranked and moved: a row knows its part by the first key of its
    class that is not in the test part (one row a class). Rows without an id are in neither part. Where ids repeat, rows are joined with the ranks of their id instead."""
    h = df.withColumn("_h", seeded_hash(seed, id_col))
    ranks = rank_keys(h, label_col, ["_h", id_col], "_rank")
    in_test = F.col("_rank") < F.round(F.col("n_class") * test_size)
    counts = F.broadcast(class_counts(ranks, label_col).withColumnRenamed(label_col, "_c"))   # one row per class
    of_class = F.col(label_col).eqNullSafe(F.col("_c"))
    if ranks.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        train = F.min(F.when(~in_test, F.struct(F.col("_h"), F.col(id_col))))
        cuts = F.broadcast(ranks.join(counts, of_class).groupBy("_c").agg(train.alias("_cut")))   # one row per class
        out = h.where(F.col(id_col).isNotNull()).join(cuts, of_class, "inner")
        is_test = F.col("_cut").isNull() | (F.struct(F.col("_h"), F.col(id_col)) < F.col("_cut"))
    else:
        out = h.join(ranks.select(id_col, "_rank"), id_col, "inner").join(counts, of_class, "inner")
        is_test = in_test
    return out.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, "split")


def stratified_folds(df: DataFrame, id_col: str, label_col: str = "label", k: int = 5, seed: int = L.SEED) -> DataFrame:
    """fold = (position within class in seeded order) mod k; fold sizes per class differ by <= 1."""
    h = df.withColumn("_h", seeded_hash(seed, id_col))
    r = rank_within(h, label_col, ["_h", id_col], "_rank")
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank")


def shuffle_index(df: DataFrame, id_col: str, seed: int = L.SEED) -> DataFrame:
    """A seeded random order as a dense 0-based index (``sample(frac=1)`` + re-index)."""
    h = df.withColumn("_h", seeded_hash(seed, id_col))
    return rank_within(h, None, ["_h", id_col], "shuffle_index").drop("_h")


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weight n / (n_classes * n_class) per row. The per-class table has one row
    per class, so the window over it and its broadcast are bounded."""
    everything = Window.partitionBy()
    stats = (class_counts(df, label_col)
             .withColumn("class_weight", F.sum("n_class").over(everything).cast("double")
                         / (F.count(F.lit(1)).over(everything) * F.col("n_class"))))
    weights = F.broadcast(stats.select(F.col(label_col).alias("_c"), "class_weight"))
    return df.join(weights, F.col(label_col).eqNullSafe(F.col("_c")), "inner").drop("_c")


def corpus_summary(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Totals, class counts and shares, mean length and words, mails with URLs."""
    from mailsignal.functions import features as E
    t = F.col(text_col)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count(F.when(F.col(label_col) == 1, 1)).cast("bigint").alias("phishing"),
        F.count(F.when(F.col(label_col) == 0, 1)).cast("bigint").alias("legitimate"),
        F.round(F.avg(E.char_count(t)).cast("decimal(38,9)"), 6).cast("double").alias("avg_length"),
        F.round(F.avg(E.word_count(t)).cast("decimal(38,9)"), 6).cast("double").alias("avg_words"),
        F.count(F.when(E.url_count_http(t) > 0, 1)).cast("bigint").alias("with_urls"),
    ).withColumn("phishing_pct", F.round(F.col("phishing") / F.col("total") * 100.0, 2))
