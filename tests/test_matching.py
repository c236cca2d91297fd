"""Dictionaries from tables: automaton and join agree with plain substring search; flags and upserts take effect."""

import random

import pytest

from mailsignal.operators import dictionary as D
from mailsignal.operators import matching as X

SCHEMA = "keyword string, category string, weight double, is_active boolean"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("limit", [None, 0, 500])
def test_equals_plain_search(spark, monkeypatch, limit):
    entries = sorted(set(words(1, 300)) | {"", "日本", "日本語だ", "x" * 300, "urgent"})
    table = [(w, "c", 1.5, [True, None, False][i % 3]) for i, w in enumerate(entries)] + [(None, "c", 1.0, True)]
    texts = [" ".join(words(i, 12)) for i in range(2, 80)] + ["", None, "URGENT 日本語だよ", "y" + "x" * 400, "É ABC", "a" * 50_000 + " urgent"]
    mails = spark.createDataFrame(list(enumerate(texts)), "email_id long, text string")
    got = X.keyword_hits(mails, spark.createDataFrame(table, SCHEMA), limit=limit)
    want = sorted((i, w) for i, t in enumerate(texts) if t is not None for w, _, _, on in table if w is not None and on is not False and w in t.lower())
    assert sorted((r.email_id, r.keyword) for r in got.collect()) == want and len(want) > 500
    assert X.keyword_hits(mails.limit(0), spark.createDataFrame(table, SCHEMA), limit=limit).count() == 0
    assert X.keyword_hits(mails, spark.createDataFrame([], SCHEMA), limit=limit).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("shortest", [4, 6, 8, 11])
def test_heads_of_any_length(spark, shortest):
    entries = sorted({w for i in range(40) for w in [" ".join(words(i, 4))[:14].strip()] if len(w.encode()) >= shortest} | {"é" * shortest, "日本語日本語日本語"})
    texts = [" ".join(words(i, 12)) for i in range(60)] + ["é" * 20, "x日本語日本語日本語日", None, "ab"]
    mails = spark.createDataFrame(list(enumerate(texts)), "email_id long, text string")
    got = X.keyword_hits(mails, spark.createDataFrame([(w, "c", 1.0, True) for w in entries], SCHEMA), limit=0)
    want = sorted((i, w) for i, t in enumerate(texts) if t is not None for w in entries if w in t.lower())
    assert sorted((r.email_id, r.keyword) for r in got.collect()) == want and len(want) > 20


def test_upsert_changes_matches(spark):
    mails = spark.createDataFrame([(1, "claim your prize"), (2, "nothing here")], "email_id long, text string")
    base = spark.createDataFrame([("prize", "reward", 1.0, True), ("nothing", "calm", 1.0, True)], SCHEMA)
    new = spark.createDataFrame([("nothing", "calm", 9.0, False), ("claim", "reward", 2.0, True)], SCHEMA)
    hits = lambda t: sorted((r.email_id, r.keyword, r.weight) for r in X.keyword_hits(mails, t).collect())
    assert hits(base) == [(1, "prize", 1.0), (2, "nothing", 1.0)]
    assert hits(D.upsert(base, new, "keyword", ["weight", "is_active"])) == [(1, "claim", 2.0), (1, "prize", 1.0)]


def test_patterns_in_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "PATTERNS", 2)
    table = spark.createDataFrame([(p, "t", 1.0, on) for p, on in ((r"bit\.ly", True), (r"^http://\d+", None), (r"secure.*bank", True), (r"\.tk$", True), ("off", False))], "pattern string, pattern_type string, weight double, is_active boolean")
    urls = ["http://bit.ly/x", "http://10.0.0.1", "https://secure-my-bank.tk", "http://off.org", None]
    df = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    got = sorted((r.id, r.pattern) for r in X.pattern_hits(df, table).collect())
    assert got == sorted([(0, r"bit\.ly"), (1, r"^http://\d+"), (2, r"secure.*bank"), (2, r"\.tk$")])
    assert X.pattern_hits(df, table.limit(0)).count() == 0
