"""Prediction-log and tracker analytics.

Each report is one scan with conditional aggregates (partial aggregation on the
map side), never one statement per number. Look-back windows are explicit
``as_of`` parameters so results are reproducible; the ``>=`` bound reaches the scan where the log is a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal import lexicon as L


def ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def cutoff(as_of: str, days: int = 0, hours: int = 0) -> Column:
    return ts(as_of) - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def since(log: DataFrame, as_of: str, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows of the look-back window; a stored log's earlier days are not read."""
    cut = cutoff(as_of, days=days, hours=hours)
    rows = log.filter(F.col("timestamp") >= cut)
    return rows.filter(F.col("day") >= F.to_date(cut)) if "day" in log.columns else rows


def _ratio_pct(num: Column, den: Column, scale: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(num.cast("double"), den.cast("double")) * 100.0, scale), F.lit(0.0))


def round_avg(c, digits: int) -> Column:
    """Rounded mean that does not depend on summation order: the double mean is first fixed to
    9 decimals, then rounded half-up (a mean on a .5 boundary rounds the same on every engine)."""
    return F.round(F.avg(c).cast("decimal(38,9)"), digits).cast("double")


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1))).cast("bigint")


# -- tracker (K1-K5) ----------------------------------------------------------------

def tracker_overall(tracker: DataFrame) -> DataFrame:
    """K1: total, labelled, correct and accuracy % in one scan."""
    return tracker.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
        F.count("actual_label").cast("bigint").alias("labeled_predictions"),
        _count_if(F.col("correct") == 1).alias("correct_predictions"),
    ).withColumn("overall_accuracy", _ratio_pct(F.col("correct_predictions"), F.col("labeled_predictions")))


def tracker_recent(tracker: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """K2: the same three counts inside the look-back window."""
    recent = since(tracker, as_of, hours=hours)
    return recent.agg(
        F.count(F.lit(1)).cast("bigint").alias("recent_total"),
        F.count("actual_label").cast("bigint").alias("recent_labeled"),
        _count_if(F.col("correct") == 1).alias("recent_correct"),
    ).withColumn("recent_accuracy", _ratio_pct(F.col("recent_correct"), F.col("recent_labeled")))


def class_breakdown(tracker: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """K3: count and average confidence per predicted class in the window."""
    recent = since(tracker, as_of, hours=hours)
    return (recent.groupBy("prediction")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                 F.coalesce(round_avg("confidence", 3), F.lit(0.0)).alias("avg_confidence"))
            .select(F.when(F.col("prediction") == 1, F.lit("Phishing")).otherwise(F.lit("Legitimate")).alias("label"),
                    "count", "avg_confidence"))


def confidence_bins(tracker: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """K4: >= 0.9 high, [0.7, 0.9) medium, < 0.7 low."""
    recent = since(tracker, as_of, hours=hours)
    c = F.col("confidence")
    return recent.agg(
        _count_if(c >= 0.9).alias("high_confidence"),
        _count_if((c >= 0.7) & (c < 0.9)).alias("medium_confidence"),
        _count_if(c < 0.7).alias("low_confidence"),
    )


def accuracy_trend(tracker: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per calendar day of the last ``days`` days (oldest first), labelled rows only;
    days without rows report zeros. One groupBy plus a date spine (no per-day query)."""
    end_day = F.to_date(ts(as_of))
    start_day = F.date_sub(end_day, days - 1)
    labelled = (tracker.filter(F.col("actual_label").isNotNull()
                               & (F.col("timestamp") >= start_day.cast("timestamp_ntz"))
                               & (F.col("timestamp") < F.date_add(end_day, 1).cast("timestamp_ntz")))
                .groupBy(F.to_date("timestamp").alias("date"))
                .agg(F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
                     F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct_predictions"),
                     F.avg("confidence").alias("_avg_conf")))
    spark = tracker.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(start_day, end_day)).alias("date"))
    # The spine holds ``days`` rows and the aggregate at most as many: broadcast is bounded.
    out = spine.join(F.broadcast(labelled), "date", "left")
    return out.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce(F.round(F.col("correct_predictions").cast("double") / F.col("total_predictions") * 100.0, 2),
                   F.lit(0.0)).alias("accuracy"),
        F.coalesce("total_predictions", F.lit(0)).cast("bigint").alias("total_predictions"),
        F.coalesce("correct_predictions", F.lit(0)).cast("bigint").alias("correct_predictions"),
        F.coalesce(F.round(F.col("_avg_conf").cast("decimal(38,9)"), 3).cast("double"), F.lit(0.0)).alias("avg_confidence"),
    )


# -- prediction log (K6-K10) ---------------------------------------------------------

def prediction_statistics(preds: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """K6: ensemble rows of the last ``days`` days; zeros when empty."""
    p = since(preds, as_of, days=days).filter(F.col("model_name") == "ensemble")
    agg = p.agg(F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
                _count_if(F.col("prediction") == 1).alias("phishing_detected"),
                F.avg("confidence").alias("_avg"),
                _count_if(F.col("risk_score") > L.HIGH_RISK).alias("high_risk_emails"))
    return agg.select(
        "total_predictions", "phishing_detected",
        (F.col("total_predictions") - F.col("phishing_detected")).alias("legitimate_emails"),
        _ratio_pct(F.col("phishing_detected"), F.col("total_predictions")).alias("phishing_rate"),
        F.coalesce(F.round(F.col("_avg").cast("decimal(38,9)"), 3).cast("double"), F.lit(0.0)).alias("average_confidence"),
        "high_risk_emails",
    )


def model_performance(preds: DataFrame, models=L.MODEL_NAMES) -> DataFrame:
    """K7: per model of the fixed list (models without rows are absent); no time filter."""
    return (preds.filter(F.col("model_name").isin(list(models)))
            .groupBy("model_name")
            .agg(F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
                 _count_if(F.col("prediction") == 1).alias("phishing_detected"),
                 round_avg("confidence", 3).alias("avg_confidence"))
            .withColumn("phishing_rate", _ratio_pct(F.col("phishing_detected"), F.col("total_predictions"))))


def model_daily_summary(preds: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """K8: by model and day over the last ``days`` days (newest day first, then model)."""
    p = since(preds, as_of, days=days)
    return (p.groupBy("model_name", F.to_date("timestamp").alias("prediction_date"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
                 _count_if(F.col("prediction") == 1).alias("phishing_detected"),
                 round_avg("confidence", 6).alias("avg_confidence"),
                 round_avg("risk_score", 6).alias("avg_risk_score"))
            .orderBy(F.desc("prediction_date"), "model_name"))


def daily_statistics(preds: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """K9: ensemble rows by day over the last ``days`` days."""
    p = since(preds, as_of, days=days).filter(F.col("model_name") == "ensemble")
    return (p.groupBy(F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("total_emails"),
                 _count_if(F.col("prediction") == 1).alias("phishing_count"),
                 _count_if(F.col("prediction") == 0).alias("legitimate_count"),
                 round_avg("confidence", 3).alias("avg_confidence"),
                 round_avg("risk_score", 2).alias("avg_risk_score"))
            .orderBy(F.desc("date")))


def recent_phishing(emails: DataFrame, preds: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Ensemble phishing rows of the last ``days`` days joined to their mail, newest first."""
    p = since(preds, as_of, days=days).filter((F.col("model_name") == "ensemble") & (F.col("prediction") == 1))
    e = emails.select("id", "sender_email", "subject")
    return (e.join(p.select("email_id", "prediction_label", "confidence", "risk_score", "timestamp"),
                   e["id"] == p["email_id"], "inner")
            .select("id", "sender_email", "subject", "prediction_label", "confidence", "risk_score", "timestamp")
            .orderBy(F.desc("timestamp")))


def recent_predictions(emails: DataFrame, preds: DataFrame, limit: int = 50) -> DataFrame:
    """L1: newest ``limit`` ensemble rows with their mail (top-k, ties broken by id)."""
    p = preds.filter(F.col("model_name") == "ensemble").select(
        F.col("id").alias("pid"), "email_id", "prediction_label", "confidence", "risk_score", "timestamp")
    # ids first: the newest rows whose mail exists, then only those (at most ``limit``) meet the parsed mails
    top = (p.join(emails.select(F.col("id").alias("email_id")), "email_id", "left_semi")
           .orderBy(F.desc("timestamp"), F.desc("pid")).limit(limit))
    e = emails.select("id", "sender_email", "subject")
    j = e.join(F.broadcast(top), F.col("email_id") == F.col("id"), "inner")
    subj = F.coalesce(F.col("subject"), F.lit(""))
    return (j.orderBy(F.desc("timestamp"), F.desc("pid")).limit(limit)
            .select(F.col("pid").alias("id"),
                    F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                    F.when(F.length(subj) > 50, F.concat(F.substring(subj, 1, 50), F.lit("..."))).otherwise(subj)
                     .alias("subject"),
                    F.col("sender_email").alias("sender"),
                    F.col("prediction_label").alias("prediction"),
                    F.round("confidence", 3).alias("confidence"),
                    F.round("risk_score", 1).alias("risk_score")))


def model_titles(df: DataFrame, col: str = "model_name") -> DataFrame:
    """S11: 'random_forest' -> 'Random Forest'."""
    return df.withColumn("model_title", F.initcap(F.replace(F.col(col), F.lit("_"), F.lit(" "))))
