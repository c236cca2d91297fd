"""Incremental rollups of the logs (K1-K5, K8, K9): mergeable partial sums kept per batch and summed when read.

A batch of tracker rows leaves one partial row for each hour and predicted class, a batch of predictions one for each day, model and class. Reports
sum the partials of all batches, so late rows only add a partial to the hours they belong to, and the log itself is read for the rows of
the one hour that a look-back window cuts in two. Rows whose label changes are corrected by a partial of the difference.
Sums of confidences are doubles, and reports fix means to 9 decimals before they round, as the full scans do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsignal.operators import analytics as K

TRACKER_SUMS = ("n", "labeled", "correct", "confidence", "labeled_confidence", "high", "medium", "low")
PREDICTION_SUMS = ("n", "confidence", "risk")


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def tracker_hours(rows: DataFrame) -> DataFrame:
    """timestamp (the hour), prediction and the sums of a batch of tracker rows."""
    c = F.col("confidence")
    return rows.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"), "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count("actual_label").alias("labeled"), _count(F.col("correct") == 1).alias("correct"),
        F.coalesce(F.sum(c), F.lit(0.0)).alias("confidence"), F.coalesce(F.sum(F.when(F.col("actual_label").isNotNull(), c)), F.lit(0.0)).alias("labeled_confidence"),
        _count(c >= 0.9).alias("high"), _count((c >= 0.7) & (c < 0.9)).alias("medium"), _count(c < 0.7).alias("low"))


def prediction_days(rows: DataFrame) -> DataFrame:
    """timestamp (the day), model_name, prediction and the sums of a batch of predictions."""
    return rows.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp"), "model_name", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.sum("risk_score"), F.lit(0.0)).alias("risk"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The partials that turn those of ``before`` into those of ``after``: two versions of the same tracker rows."""
    minus = tracker_hours(before).select("timestamp", "prediction", *[(-F.col(c)).alias(c) for c in TRACKER_SUMS])
    return tracker_hours(after).unionByName(minus).groupBy("timestamp", "prediction").agg(*[F.sum(c).alias(c) for c in TRACKER_SUMS]).where("n <> 0 or labeled <> 0 or correct <> 0")


def _pct(num: str, den: str) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")) * 100.0, 2), F.lit(0.0))


def _mean(total: str, n: str, digits: int) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(total), F.col(n)).cast("decimal(38,9)"), digits).cast("double"), F.lit(0.0))


def _total(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("double" if "confidence" in c or c == "risk" else "bigint").alias(c) for c in names]


def window_sums(hours: DataFrame, log: DataFrame, as_of: str, hours_back: int) -> DataFrame:
    """Partials of a look-back window: whole hours from the rollup, the rows of the hour that the cut-off falls in from the log."""
    cut = K.cutoff(as_of, hours=hours_back)
    whole = F.date_trunc("hour", cut + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    # the first whole hour: the cut-off itself where it is one
    first = F.when(F.date_trunc("hour", cut).cast("timestamp_ntz") == cut, cut).otherwise(whole)
    kept = hours.where(F.col("timestamp") >= first)
    edge = log.where((F.col("timestamp") >= cut) & (F.col("timestamp") < first))
    if "day" in log.columns:
        edge = edge.where(F.col("day") == F.to_date(cut))
    return kept.select("timestamp", "prediction", *TRACKER_SUMS).unionByName(tracker_hours(edge))


def overall(hours: DataFrame) -> DataFrame:
    """K1."""
    t = hours.agg(*_total("n", "labeled", "correct"))
    return t.select(F.col("n").alias("total_predictions"), F.col("labeled").alias("labeled_predictions"), F.col("correct").alias("correct_predictions"),
                    _pct("correct", "labeled").alias("overall_accuracy"))


def recent(sums: DataFrame) -> DataFrame:
    """K2 over ``window_sums``."""
    t = sums.agg(*_total("n", "labeled", "correct"))
    return t.select(F.col("n").alias("recent_total"), F.col("labeled").alias("recent_labeled"), F.col("correct").alias("recent_correct"), _pct("correct", "labeled").alias("recent_accuracy"))


def by_class(sums: DataFrame) -> DataFrame:
    """K3 over ``window_sums``."""
    t = sums.groupBy("prediction").agg(*_total("n", "confidence")).where("n > 0")
    return t.select(F.when(F.col("prediction") == 1, "Phishing").otherwise("Legitimate").alias("label"), F.col("n").alias("count"), _mean("confidence", "n", 3).alias("avg_confidence"))


def bins(sums: DataFrame) -> DataFrame:
    """K4 over ``window_sums``."""
    return sums.agg(*_total("high", "medium", "low")).toDF("high_confidence", "medium_confidence", "low_confidence")


def trend(hours: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """K5: a row for each of the last ``days`` days, oldest first."""
    end = F.to_date(K.ts(as_of))
    start = F.date_sub(end, days - 1)
    date = F.to_date("timestamp")
    some = hours.where((date >= start) & (date <= end))
    t = some.groupBy(date.alias("d")).agg(*_total("labeled", "correct", "labeled_confidence"))
    spine = hours.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    out = spine.join(F.broadcast(t), F.col("date") == F.col("d"), "left").na.fill(0)   # ``days`` rows on either side
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), _pct("correct", "labeled").alias("accuracy"), F.col("labeled").alias("total_predictions"),
                      F.col("correct").alias("correct_predictions"), _mean("labeled_confidence", "labeled", 3).alias("avg_confidence"))


def _recent_days(days_: DataFrame, log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Partials of the last ``days`` days; the day that the cut-off falls in comes from the log, from the cut-off on."""
    cut = K.cutoff(as_of, days=days)
    day = F.to_date(cut)
    kept, edge = days_.where(F.to_date("timestamp") > day), log.where((F.col("timestamp") >= cut) & (F.to_date("timestamp") == day))
    if "day" in log.columns:
        edge = edge.where(F.col("day") == day)
    return kept.select("timestamp", "model_name", "prediction", *PREDICTION_SUMS).unionByName(prediction_days(edge))


def model_daily(days_: DataFrame, log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """K8."""
    t = _recent_days(days_, log, as_of, days).groupBy("model_name", F.to_date("timestamp").alias("prediction_date")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("prediction") == 1, F.col("n")).otherwise(0)).alias("phishing_detected"), F.sum("confidence").alias("confidence"), F.sum("risk").alias("risk")).where("n > 0")
    return t.select("model_name", "prediction_date", F.col("n").alias("total_predictions"), "phishing_detected", _mean("confidence", "n", 6).alias("avg_confidence"),
                    _mean("risk", "n", 6).alias("avg_risk_score")).orderBy(F.desc("prediction_date"), "model_name")


def daily(days_: DataFrame, log: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """K9."""
    some = _recent_days(days_, log, as_of, days).where(F.col("model_name") == "ensemble")
    is_ = lambda p: F.sum(F.when(F.col("prediction") == p, F.col("n")).otherwise(0))
    t = some.groupBy(F.to_date("timestamp").alias("date")).agg(F.sum("n").alias("n"), is_(1).alias("phishing_count"), is_(0).alias("legitimate_count"),
                                                              F.sum("confidence").alias("confidence"), F.sum("risk").alias("risk")).where("n > 0")
    return t.select("date", F.col("n").alias("total_emails"), "phishing_count", "legitimate_count", _mean("confidence", "n", 3).alias("avg_confidence"),
                    _mean("risk", "n", 2).alias("avg_risk_score")).orderBy(F.desc("date"))
