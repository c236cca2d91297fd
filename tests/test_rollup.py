"""Partial sums equal the full scans after any split of the log into batches, late rows and corrections included."""

import datetime
import random

import pytest

from mailsignal.operators import analytics as K
from mailsignal.operators import rollup as U

SCHEMA = "id long, timestamp timestamp_ntz, prediction int, confidence double, actual_label int, correct int"
START = datetime.datetime(2024, 1, 1)


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label, p = rng.choice([None, 0, 1]), rng.randrange(2)
        at = START + datetime.timedelta(seconds=rng.choice([rng.randrange(86400 * 6), 3600 * rng.randrange(140)]))
        out.append((i, at, p, rng.choice([0.7, 0.9, rng.random()]), label, None if label is None else int(label == p)))
    return out


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split(spark, seed):
    data = rows(seed, 400)
    log = spark.createDataFrame(data, SCHEMA)
    rng = random.Random(seed)
    dealt = [rng.randrange(4) for _ in data]
    hours = None
    for b in range(5):   # the fifth batch is empty
        part = U.tracker_hours(spark.createDataFrame([r for r, d in zip(data, dealt) if d == b], SCHEMA))
        hours = part if hours is None else hours.unionByName(part)
    hours = hours.checkpoint()
    assert plain(U.overall(hours)) == plain(K.tracker_overall(log))
    assert plain(U.trend(hours, "2024-01-06 12:00:00", 8)) == plain(K.accuracy_trend(log, "2024-01-06 12:00:00", 8))
    for as_of, back in (("2024-01-05 00:00:00", 24), ("2024-01-05 07:12:09", 30), ("2024-02-05 00:00:00", 3)):
        sums = U.window_sums(hours, log, as_of, back)
        assert plain(U.recent(sums)) == plain(K.tracker_recent(log, as_of, back))
        assert plain(U.by_class(sums)) == plain(K.class_breakdown(log, as_of, back))
        assert plain(U.bins(sums)) == plain(K.confidence_bins(log, as_of, back))


def test_corrections(spark):
    data = rows(3, 200)
    new = [(i, t, p, c, 1 - p, 0) if i % 3 == 0 else r for r in data for i, t, p, c, *_ in [r]]
    before, after = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(new, SCHEMA)
    changed = U.difference(before.where("id % 3 = 0"), after.where("id % 3 = 0"))
    hours = U.tracker_hours(before).unionByName(changed)
    assert plain(U.overall(hours)) == plain(K.tracker_overall(after))
    assert plain(U.trend(hours, "2024-01-06 00:00:00", 7)) == plain(K.accuracy_trend(after, "2024-01-06 00:00:00", 7))
    assert U.difference(before, before).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert plain(U.overall(U.tracker_hours(none))) == plain(K.tracker_overall(none))
