"""Words and bigrams counted as numbers against the plain form: every term exploded and grouped."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsignal.operators import vectorize as V

ROWS = [(1, "Free PRIZE, free prize now: claim the prize", 1), (2, "the meeting agenda; meeting notes a b c", 0), (3, None, 0), (4, "", 1), (5, " . ", 0), (6, "the and of", 1),
        (7, "Größe İstanbul naïve free-prize x_1 2024 2024", 0), (7, "free prize again", 0), (None, "claim prize", 1), (None, "claim prize meeting", 1), (8, "prize " * 500, 1),
        (9, "meeting agenda meeting agenda", 0), (10, "solo", 1), (11, "free prize claim meeting agenda notes", 1), (11, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, label int").repartition(3).checkpoint()


def plain_vocabulary(docs, most, min_df, max_df):
    terms = V.doc_terms(docs, "id", "text")
    total = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    df = terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = df.join(total, "term").where((F.col("df") >= min_df) & (F.col("df") <= math.floor(max_df * docs.count())))
    rows = sorted((-r.total, r.term, r.df) for r in band.collect())[:most]
    return sorted((t, d, -n) for n, t, d in rows)


def plain_weights(docs, vocab, sublinear):
    v = vocab.select("term", "idx", V.idf_column().alias("idf"))
    tc = V.doc_terms(docs, "id", "text").select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")).join(v, "term")
    w = tc.withColumn("w", (F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


@pytest.mark.parametrize("most", [2, 4, 7, 100])
@pytest.mark.parametrize("slice_bytes", [1, 40, 1 << 20])
def test_vocabulary_is_the_plain_one(spark, docs, monkeypatch, most, slice_bytes):
    """Whatever the slices, and whether bigrams are first held to their share of the last word's occurrences or all counted."""
    monkeypatch.setattr(V, "SLICE_BYTES", slice_bytes)
    want = plain_vocabulary(docs, most, 2, 0.9)
    for candidates in (0, 1 << 17):
        monkeypatch.setattr(V, "CANDIDATES", candidates)
        got = V.fit_vocabulary(docs, "id", "text", most, 2, 0.9).collect()
        assert [(r.term, r.df, r.total) for r in sorted(got, key=lambda r: r.idx)] == want
        assert [r.idx for r in sorted(got, key=lambda r: r.term)] == list(range(len(want))) and all(r.n_docs == len(ROWS) for r in got)


@pytest.mark.parametrize("sublinear", [False, True])
def test_weights_are_the_plain_ones(spark, docs, monkeypatch, sublinear):
    """Rows of one id, also without one, are one document; batches of one row merge like whole ones."""
    vocab = V.fit_vocabulary(docs, "id", "text", 100, 1, 1.0).checkpoint()
    want = {(r.id, r.term): (r.idx, r.w) for r in plain_weights(docs, vocab, sublinear).collect()}
    for size, records in ((1, 1), (1 << 20, 10_000)):
        monkeypatch.setattr(V, "SLICE_BYTES", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = V.tfidf(docs, vocab, "id", "text", sublinear, digits=None, carry=("label",)).collect()
            lists = V.weight_lists(docs, vocab, "id", "text", sublinear).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {(r.id, r.term): (r.idx, pytest.approx(r.weight)) for r in got} == want
        assert {(r.id, r.label) for r in got} <= {(i, y) for i, _, y in ROWS}
        assert len(lists) == len({i for i, _ in want}) and all(r.idx == sorted(r.idx) and sum(x * x for x in r.weight) == pytest.approx(1) for r in lists)


def test_one_short_row_a_text_is_exchanged(spark, docs):
    """The exchange carries a list a text, not a row a word."""
    vocab = V.fit_vocabulary(docs, "id", "text", 100, 1, 1.0).checkpoint()
    plan = V.weight_lists(docs, vocab, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan


def test_no_terms_at_all(spark):
    blank = spark.createDataFrame([(1, None), (2, " "), (3, "a b")], "id long, text string")
    vocab = V.fit_vocabulary(blank, "id", "text")
    assert vocab.count() == 0 and V.tfidf(blank, vocab, "id", "text").count() == 0 and V.weight_lists(blank, vocab, "id", "text").count() == 0
