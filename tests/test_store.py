"""Stored logs: replayed and half-written batches, pruning, retention against the plain tables, several writers."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from mailsignal.operators import analytics as K
from mailsignal.operators import retention as R
from mailsignal.session import scratch_path
from mailsignal.sources import logs, views
from mailsignal.sources.store import LogStore, fingerprint


@pytest.fixture
def store(spark):
    import uuid
    return LogStore(spark, scratch_path(spark, "test-store", uuid.uuid4().hex))


def preds(spark, rows):
    full = [(i, e, m, p, 0.5 + p / 4, 10.0, datetime.datetime.fromisoformat(t)) for i, e, m, p, t in rows]
    return spark.createDataFrame(full, "id long, email_id long, model_name string, prediction int, confidence double, risk_score double, timestamp timestamp_ntz")


ROWS = [(1, 1, "ensemble", 1, "2024-01-01 10:00:00"), (2, 1, "svm", 0, "2024-01-01 10:00:00"), (3, 2, "ensemble", 0, "2024-01-02 00:00:00"), (4, None, "ensemble", 1, "2024-01-02 23:59:59")]


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_same_batch_twice_is_once(spark, store):
    assert store.append("b1", predictions=preds(spark, ROWS[:2])) and not store.append("b1", predictions=preds(spark, ROWS[:2]))
    assert store.append("b2", predictions=preds(spark, ROWS[2:]))
    again = LogStore(spark, store.root)   # a restarted job
    assert not again.append("b2", predictions=preds(spark, ROWS[2:])) and ids(again.read("predictions")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        store.append("b/3", predictions=preds(spark, ROWS))


def test_unpublished_files_are_not_seen(spark, store, monkeypatch):
    store.append("b1", predictions=preds(spark, ROWS[:2]))
    monkeypatch.setattr(store, "_publish", lambda change: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append("b2", predictions=preds(spark, ROWS[1:]))       # written, never published
    again = LogStore(spark, store.root)
    assert ids(again.read("predictions")) == [1, 2]
    assert again.append("b2", predictions=preds(spark, ROWS[2:])) and ids(again.read("predictions")) == [1, 2, 3, 4]
    store.vacuum()
    assert ids(again.read("predictions")) == [1, 2, 3, 4]


def test_two_writers(spark, store, monkeypatch):
    other = LogStore(spark, store.root)
    versions = store._versions
    raced = []

    def stale():
        seen = versions()
        if not raced:
            raced.append(other.append("o1", predictions=preds(spark, ROWS[2:])))
        return seen
    store.append("b0", predictions=preds(spark, []))
    monkeypatch.setattr(store, "_versions", stale)
    store._publish(lambda state: state)
    assert raced == [True] and ids(store.read("predictions")) == [3, 4]


def test_reports_prune_partitions(spark, store):
    store.append("b1", predictions=preds(spark, ROWS))
    log = store.read("predictions")
    for report in (K.prediction_statistics(log, "2024-01-03 00:00:00", days=1), K.model_daily_summary(log, "2024-01-03 00:00:00", days=1), K.daily_statistics(log, "2024-01-03 00:00:00", days=1)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
        assert "day" in filters and "batch" in filters
    plan = K.model_performance(log)._jdf.queryExecution().executedPlan().toString()
    assert "model_name" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    got = K.prediction_statistics(log, "2024-01-03 00:00:00", days=1).first()
    assert (got.total_predictions, got.phishing_detected) == (2, 1)


def test_retention_equals_the_plain_tables(spark, store):
    emails, p, a = logs.emails(spark, SMALL), logs.predictions(spark, SMALL), logs.activity(spark, SMALL)
    for name, part in (("even", 0), ("odd", 1)):
        half = lambda df: df.where(F.col("id") % 2 == part)  # noqa: E731,B023
        store.append(name, emails=half(emails), predictions=half(p), user_activity=half(a))
    as_of = views.MAIL_AS_OF
    assert store.retention(as_of, 90) and not store.retention(as_of, 90)
    for days in (90, 60):
        store.retention(as_of, days)
        emails, p, a = R.retention(emails, p, a, as_of, days)
        for name, want in (("emails", emails), ("predictions", p), ("user_activity", a)):
            assert ids(store.read(name)) == ids(want)
        store.vacuum()
        assert ids(store.read("emails")) == ids(emails)
    store.append("late", predictions=preds(spark, [(-5, None, "svm", 1, "2023-01-01 00:00:00")]))   # a late row counts until the next clean-up
    assert -5 in ids(store.read("predictions"))


def test_fingerprint_changes_with_the_files(spark):
    path = scratch_path(spark, "print", "t.parquet")
    spark.range(3).write.mode("overwrite").parquet(path)
    first = fingerprint(spark, path)
    assert first == fingerprint(spark, path)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fingerprint(spark, path) != first


def test_branches_share_batches(spark, store):
    store.append("b1", predictions=preds(spark, ROWS), emails=preds(spark, ROWS))
    side = store.fork("tried")
    assert side.retention("2024-01-02 12:00:00", 0) and ids(side.read("predictions")) == [4] and ids(store.read("predictions")) == [1, 2, 3, 4]
    store.vacuum()
    side.vacuum()
    assert ids(store.read("predictions")) == [1, 2, 3, 4] and ids(store.fork("tried").read("predictions")) == [4]
    store.append("b2", predictions=preds(spark, [(9, 1, "svm", 1, "2024-01-05 00:00:00")]))
    assert ids(side.read("predictions")) == [4]


def test_orphans_are_looked_up_in_the_whole_log(spark):
    from mailsignal.plans.catalog import orphan_emails
    found = ids(orphan_emails(spark, SMALL))
    named = {r.email_id for r in logs.stored(spark, SMALL, "predictions").select("email_id").distinct().collect()}
    assert found and not named & set(found)


def test_a_report_fills_only_its_own_tables(spark, tmp_path):
    import shutil
    for t in ("documents", "events"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = logs.store(spark, str(tmp_path), "tracker")
    assert set(first.snapshot()) == {"tracker"} and not (first.append("load", tracker=views.tracker(spark, str(tmp_path))))
    assert ids(logs.stored(spark, str(tmp_path), "tracker")) == ids(logs.stored(spark, SMALL, "tracker"))
    assert set(logs.store(spark, str(tmp_path)).snapshot()) == set(logs.TABLES)
