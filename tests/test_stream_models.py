"""Streams with fitted models and keyed state: several batches, late and repeated rows, restarts."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from mailsignal.operators import models as H
from mailsignal.operators import retention as R
from mailsignal.session import scratch_path
from mailsignal.sources import views
from mailsignal.sources.store import LogStore
from mailsignal.streaming import jobs


def folder(spark, name):
    return scratch_path(spark, "stream-tests", f"{name}-{uuid.uuid4().hex}")


def plain(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_state_equals_the_batch_result_after_every_batch(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = events.orderBy("event_id").collect()
    random.Random(2).shuffle(rows)      # late rows: parts do not follow event time
    parts = [rows[:300], rows[300:320], rows[320:700] + rows[:40], rows[700:]]     # and some rows come twice
    base, out = folder(spark, "events"), folder(spark, "state")
    seen = []
    for part in parts:
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
        seen += part
        now = spark.createDataFrame(list(dict.fromkeys(seen)), events.schema)
        got = jobs.stream_feedback_state(spark, base, out, files_per_trigger=1).dropDuplicates()
        assert plain(got) == plain(R.feedback_apply(views.tracker_from_events(now), views.feedback_from_events(now)))
    again = jobs.stream_feedback_state(spark, base, out).dropDuplicates()     # nothing new
    assert plain(again) == plain(got)


@pytest.fixture(scope="module")
def trained(spark):
    return H.train(views.raw_mails(spark, SMALL).select("email_id", "raw_text", "label"), num_trees=5, max_depth=5)


def test_streamed_models_equal_the_batch_job(spark, trained):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base, sink = folder(spark, "docs"), LogStore(spark, folder(spark, "sink"))
    want = {r.email_id: (r.rf_prediction, round(r.rf_probability_phishing, 9), round(r.svm_probability_phishing, 9)) for r in H.score(trained, trained.every).collect()}
    have = set()
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).repartition(3).write.mode("append").parquet(f"{base}/documents.parquet")
        got = jobs.stream_model_scores(spark, base, trained, "m1", LogStore(spark, sink.root), files_per_trigger=1).collect()
        assert len(got) == len({r.email_id for r in got})
        have = {r.email_id for r in got}
        assert {r.email_id: (r.rf_prediction, round(r.rf_probability_phishing, 9), round(r.svm_probability_phishing, 9)) for r in got} == {i: want[i] for i in have}
    assert have == set(want)
    # a failure between the append and the stream's own commit: the batch comes again and is there once
    batches = sink.snapshot()["scores"]["batches"]
    assert len(batches) >= 4 and not sink.append(next(iter(batches)), scores=sink.read("scores").drop("day", "batch"))
    other = jobs.stream_model_scores(spark, base, trained, "m2", sink)     # another version of the models scores all mails again
    assert other.count() == len(want) and sink.read("scores").count() == 2 * len(want)
