"""Invariants on the driver tables: splits, folds, norms, AUC symmetry, stream = batch, dictionaries."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from mailsignal.operators import dictionary as D
from mailsignal.operators import evaluate as J
from mailsignal.operators import models as H
from mailsignal.operators import split as G
from mailsignal.operators import vectorize as V
from mailsignal.sources import views

from conftest import SMALL


def test_split_is_disjoint_complete_and_stratified(spark):
    m = views.raw_mails(spark, SMALL).select("email_id", "label")
    s = G.stratified_split(m, "email_id")
    assert s.count() == m.count() and s.select("email_id").distinct().count() == m.count()
    for r in s.groupBy("label").agg(F.count(F.when(F.col("split") == "test", 1)).alias("t"),
                                    F.count(F.lit(1)).alias("n")).collect():
        assert r.t == round(r.n * 0.2)


def test_fold_sizes_differ_by_at_most_one(spark):
    m = views.raw_mails(spark, SMALL).select("email_id", "label")
    f = G.stratified_folds(m, "email_id", k=5)
    sizes = f.groupBy("label", "fold").count()
    for r in sizes.groupBy("label").agg(F.max("count").alias("hi"), F.min("count").alias("lo")).collect():
        assert r.hi - r.lo <= 1


def test_tfidf_rows_have_unit_norm(spark):
    c = views.raw_mails(spark, SMALL).select("email_id", "raw_text")
    w = V.tfidf(c, V.fit_vocabulary(c, "email_id", "raw_text"), "email_id", "raw_text", digits=None)
    norms = w.groupBy("email_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_auc_of_negated_scores(spark):
    ev = views.raw_mails(spark, SMALL).select(F.lit("m").alias("g"), "label",
                                              ((F.col("email_id") * 37) % 1000).cast("double").alias("score"))
    a = J.roc_auc(ev, "g").first().roc_auc
    b = J.roc_auc(ev.withColumn("score", -F.col("score")), "g").first().roc_auc
    assert abs(a + b - 1.0) < 1e-12


def test_inactive_entries_are_skipped(spark):
    m = spark.createDataFrame([(1, "URGENT prize")], "email_id long, raw_text string")
    entries = [("urgent", "a", 1.0, True), ("prize", "b", 2.0, False), ("gent", "c", 3.0, None)]
    assert sorted(r.keyword for r in D.keyword_hits(m, entries, "raw_text").collect()) == ["gent", "urgent"]
    assert D.keyword_hits(m, [], "raw_text").count() == 0


def _split_copy(spark, path, name, files):
    spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(files).write.parquet(f"{path}/{name}.parquet")


def test_streams_over_table_folders(spark, tmp_path):
    from mailsignal.operators import retention as R
    from mailsignal.streaming import jobs
    for name in ("documents", "events"):
        _split_copy(spark, str(tmp_path), name, 5)
    assert jobs.stream_score(spark, str(tmp_path)).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    base = str(tmp_path / "corrections")
    want = sorted(map(str, R.feedback_apply(views.tracker(spark, SMALL), views.feedback(spark, SMALL)).collect()))
    for _ in range(2):  # several batches, then a restart on the same folder
        assert sorted(map(str, jobs.stream_feedback(spark, str(tmp_path), base, files_per_trigger=1).collect())) == want


def test_stream_score_equals_batch(spark):
    from mailsignal.plans.catalog import QUERIES
    s = QUERIES["stream_score"](spark, SMALL).select("email_id", "risk_score", "ensemble_prediction")
    b = QUERIES["ensemble_vote"](spark, SMALL).join(QUERIES["risk_score"](spark, SMALL), "email_id") \
        .select("email_id", "risk_score", "ensemble_prediction")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_stemmer_job_equals_python(spark):
    from plain_porter import stem
    from mailsignal.plans.catalog import QUERIES
    a = {r.email_id: r.stems for r in QUERIES["porter_stem"](spark, SMALL).collect()}
    b = {r.email_id: r.tokens for r in QUERIES["stopword_filter"](spark, SMALL).collect()}
    assert all(a[k] == " ".join(stem(w) for w in b[k].split(" ") if w) for k in b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def mails(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_split_leaves_texts_where_they_lie(spark):
    rows = [(i, f"text {i}", None if i % 11 == 0 else i % 3) for i in range(400)]
    once = G.stratified_split(mails(spark, rows), "id")
    assert once.columns == ["id", "text", "label", "split"]
    found = {r.id: r.split for r in once.collect()}
    for label in (None, 0, 1, 2):
        order = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, _, x in rows if x == label)
        n = math.floor(len(order) * 0.2 + 0.5)
        assert [found[i] for _, i in order] == ["test"] * n + ["train"] * (len(order) - n)
    assert "hashpartitioning(id" not in plan(once)   # no join on the id moves the texts


def test_split_with_repeated_and_null_ids_joins_the_ranks(spark):
    rows = [(i, f"text {i}", i % 2) for i in range(60)]
    got = Counter(r.id for r in G.stratified_split(mails(spark, rows + rows[:5] + [(None, "x", 1)]), "id").collect())
    assert got == {i: 4 if i < 5 else 1 for i in range(60)}
    assert G.stratified_split(mails(spark, rows + [(None, "x", 1)]), "id").count() == 60


def test_tfidf_moves_numbers_once(spark):
    docs = mails(spark, [(1, "alpha beta alpha", 0), (1, "beta gamma", 0), (2, "gamma", 1), (None, "alpha", 1), (3, None, 0)])
    vocab = spark.createDataFrame([("alpha", 0, 2), ("alpha beta", 1, 1), ("beta", 2, 2), ("gamma", 3, 2)], "term string, idx long, df long").selectExpr("*", "5L n_docs")
    w = V.tfidf(docs, vocab, "id", "text", carry=("label",))
    assert plan(w).count("Exchange hashpartitioning(") == 1
    got = sorted(((r.id is None, r.id, r.term), r.idx, r.weight) for r in w.collect())
    assert [(k[1], k[2], i) for k, i, _ in got] == [(1, "alpha", 0), (1, "alpha beta", 1), (1, "beta", 2), (1, "gamma", 3), (2, "gamma", 3), (None, "alpha", 0)]
    idf = {t: math.log(6 / (1 + n)) + 1 for t, n in (("alpha", 2), ("alpha beta", 1), ("beta", 2), ("gamma", 2))}
    raw = {"alpha": (1 + math.log(2)) * idf["alpha"], "alpha beta": idf["alpha beta"], "beta": (1 + math.log(2)) * idf["beta"], "gamma": idf["gamma"]}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert all(abs(x - (raw[k[2]] / norm if k[1] == 1 else 1)) < 1e-8 for k, _, x in got)
    assert w.columns == ["id", "label", "term", "idx", "weight"]


def test_fits_keep_node_statistics_small():
    assert 4 * H.FOREST_MEMORY_MB <= 0.1 * 6000   # four tasks of a 10 GB executor, 60 % of it heap
    assert [H.fit_parts(n, 12) for n in (0, 1, 41_000, 410_000, 2_460_000)] == [1, 1, 11, 24, 76]
