"""Dimension upsert (INSERT ... ON DUPLICATE KEY UPDATE) and newest-row de-duplication."""

from pyspark.sql import functions as F

from mailsignal.operators import dictionary as D


def test_upsert_updates_only_named_columns(spark):
    base = spark.createDataFrame([("urgent", "urgency", 5.0, True, "2024-01-01 00:00:00")],
                                 "keyword string, category string, weight double, is_active boolean, u string") \
        .withColumn("updated_at", F.col("u").cast("timestamp_ntz")).drop("u")
    upd = spark.createDataFrame([("urgent", "other", 9.0), ("wire transfer", "financial", 7.5)],
                                "keyword string, category string, weight double")
    out = {r.keyword: r for r in D.upsert(base, upd, "keyword", ["weight"], as_of="2024-02-01 00:00:00").collect()}
    assert out["urgent"].weight == 9.0 and out["urgent"].category == "urgency"        # only weight overwritten
    assert str(out["urgent"].updated_at) == "2024-02-01 00:00:00"
    assert out["wire transfer"].category == "financial" and out["wire transfer"].weight == 7.5


def test_dedup_keeps_newest(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 3), ("j", "c", 2)], "config_key string, v string, ts int")
    got = {r.config_key: r.v for r in D.dedup_newest(df, "config_key", "ts").collect()}
    assert got == {"k": "b", "j": "c"}


def test_url_pattern_seed_matches(spark):
    urls = spark.createDataFrame([("http://bit.ly/x",), ("http://10.0.0.1/a",), ("https://example.org",)], "url string")
    hits = D.url_pattern_hits(urls, D.url_pattern_entries())
    got = sorted((r.url, r.pattern_type) for r in hits.collect())
    assert ("http://bit.ly/x", "shortened") in got and ("http://10.0.0.1/a", "suspicious") in got
    assert not [g for g in got if g[0] == "https://example.org"]
