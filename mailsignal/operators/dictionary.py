"""Keyword and URL-pattern dimensions: match, upsert, de-duplicate.

Matching is a substring or regex test of every text against a small dictionary. The dictionary's entries
become literals of one array expression, ``inline`` makes rows of those found: no join, no shuffle, and each
regex is compiled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal import lexicon as L


def keyword_dimension(spark: SparkSession) -> DataFrame:
    rows = [(k, c, float(w), True) for k, c, w in L.KEYWORD_SEED]
    return spark.createDataFrame(rows, "keyword string, category string, weight double, is_active boolean")


def url_pattern_dimension(spark: SparkSession) -> DataFrame:
    rows = [(p, t, float(w), True) for p, t, w in L.URL_PATTERN_SEED]
    return spark.createDataFrame(rows, "pattern string, pattern_type string, weight double, is_active boolean")


def keyword_entries() -> list[tuple]:
    """(keyword, category, weight, is_active) of the seeded dimension."""
    return [(k, c, float(w), True) for k, c, w in L.KEYWORD_SEED]


def url_pattern_entries() -> list[tuple]:
    """(pattern, pattern_type, weight, is_active) of the seeded dimension."""
    return [(p, t, float(w), True) for p, t, w in L.URL_PATTERN_SEED]


def _found(entries: list[tuple], names: tuple[str, str], hit) -> Column:
    """Array of the active entries (a null flag counts as active) for which ``hit`` holds."""
    row = lambda e: F.struct(F.lit(e[0]).alias(names[0]), F.lit(e[1]).alias(names[1]), F.lit(float(e[2])).alias("weight"))
    cases = [F.when(hit(e[0]), row(e)) for e in entries if e[3] is None or e[3]]
    empty = F.array().cast(f"array<struct<{names[0]}:string,{names[1]}:string,weight:double>>")
    return F.array_compact(F.array(*cases)) if cases else empty


def keyword_hits(mails: DataFrame, entries: list[tuple], text_col: str = "text", id_col: str = "email_id") -> DataFrame:
    """L4: one row per (mail, active keyword found as a substring of the lower-cased text)."""
    low = mails.select(F.col(id_col).alias("email_id"), F.lower(F.col(text_col)).alias("_low"))
    return low.select("email_id", F.inline(_found(entries, ("keyword", "category"), lambda k: F.col("_low").contains(k))))


def keyword_category_score(hits: DataFrame) -> DataFrame:
    """L4: per mail and category: hits and weighted total."""
    return (hits.groupBy("email_id", "category")
            .agg(F.count(F.lit(1)).cast("bigint").alias("hits"),
                 F.round(F.sum("weight"), 6).alias("weighted_score")))


def url_pattern_hits(urls: DataFrame, entries: list[tuple], url_col: str = "url") -> DataFrame:
    """One row per (URL, active pattern whose regex finds a match in it)."""
    return urls.select("*", F.inline(_found(entries, ("pattern", "pattern_type"), lambda p: F.col(url_col).rlike(p))))


def upsert(base: DataFrame, updates: DataFrame, key: str, update_cols: list[str], as_of: str | None = None) -> DataFrame:
    """Insert new keys, overwrite only ``update_cols`` of existing ones
    (``INSERT ... ON DUPLICATE KEY UPDATE``); ``updated_at`` is touched on changed rows."""
    b = base.alias("b")
    n = updates.alias("n")
    j = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = []
    for c in base.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"b.{key}"), F.col(f"n.{key}")).alias(key))
        elif c in update_cols:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c))
        elif c == "updated_at" and as_of is not None:
            changed = F.col(f"n.{key}").isNotNull()
            cols.append(F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col(f"b.{c}")).alias(c))
        elif c in updates.columns:
            cols.append(F.when(F.col(f"b.{key}").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.col(f"b.{c}").alias(c))
    return j.select(*cols)


def dedup_newest(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """M8: one row per key, the newest by ``order_col`` (aggregate, skew-safe)."""
    others = [c for c in df.columns if c not in (key, order_col)]
    best = F.max(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in [order_col] + others]) \
        .select(*df.columns)
