"""Latest-row selection, feedback application, retention and referential checks
(M1, N1, N2, L3, L8, L9).

Hot keys: a single mail hash or mail id may hold a large share of rows, so
"latest per key" is a ``max(struct(...))`` aggregate (partial aggregation on the
map side) instead of a window that would pull a whole key into one task, and
anti/semi joins run against de-duplicated key sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.operators.analytics import cutoff


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], keep: list[str]) -> DataFrame:
    """Newest row per ``key`` by ``order_cols`` (last one is the tie-breaker), as one aggregate."""
    fields = list(dict.fromkeys(order_cols + keep))
    best = F.max(F.struct(*[F.col(c) for c in fields])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in fields])


def latest_prediction(tracker: DataFrame) -> DataFrame:
    """M1: newest tracker row per mail hash (ties in time broken by the higher id)."""
    return latest_per_key(tracker, "email_hash", ["created_at", "id"], ["prediction"])


def feedback_apply(tracker: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set actual_label, user_feedback and correct on the newest row of each hash that
    received feedback; within one batch the newest feedback for a hash wins.
    Applying the same batch twice gives the same table (idempotent)."""
    fb = latest_per_key(feedback, "email_hash", ["feedback_at", "feedback_id"], ["actual_label", "feedback"]) \
        .select("email_hash", F.col("actual_label").alias("fb_label"), F.col("feedback").alias("fb_text"))
    target = latest_prediction(tracker).select("email_hash", F.col("id").alias("target_id"))
    return apply_updates(tracker, target.join(fb, "email_hash", "inner").select("target_id", F.col("fb_label").alias("actual_label"), F.col("fb_text").alias("feedback")))


def apply_updates(tracker: DataFrame, updates: DataFrame) -> DataFrame:
    """The tracker with (target_id, actual_label, feedback) written to its rows; at most one update a row."""
    updates = updates.select("target_id", F.col("actual_label").alias("fb_label"), F.col("feedback").alias("fb_text"))
    j = tracker.join(updates, tracker["id"] == updates["target_id"], "left")
    hit = F.col("target_id").isNotNull()
    out = j.select(
        "id", "timestamp", "prediction", "confidence",
        F.when(hit, F.col("fb_label")).otherwise(F.col("actual_label")).cast("int").alias("actual_label"),
        F.when(hit, F.col("fb_text")).otherwise(F.col("user_feedback")).alias("user_feedback"),
        "email_hash", "created_at",
    )
    return out.withColumn("correct", F.when(F.col("actual_label").isNotNull(),
                                            (F.col("prediction") == F.col("actual_label")).cast("int")))


def feedback_unmatched(tracker: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback rows whose hash has no tracker row (the 'not found' replies)."""
    known = tracker.select("email_hash").distinct()
    return feedback.join(known, "email_hash", "left_anti")


def feedback_valid(requests: DataFrame) -> DataFrame:
    """Hash non-empty and label present; label cast to int (bad values rejected)."""
    return (requests.withColumn("actual_label", F.col("actual_label").try_cast("int"))
            .filter(F.col("email_hash").isNotNull() & (F.col("email_hash") != "") & F.col("actual_label").isNotNull()))


def orphan_emails(emails: DataFrame, preds: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """L3: mails older than the cutoff with no prediction (null ids in the log ignored)."""
    ids = preds.filter(F.col("email_id").isNotNull()).select(F.col("email_id").alias("id")).distinct()
    old = emails.filter(F.col("timestamp") < cutoff(as_of, days=days))
    return old.join(ids, "id", "left_anti")


def orphan_predictions(emails: DataFrame, preds: DataFrame) -> DataFrame:
    """Prediction rows whose mail does not exist (unknown or null email_id)."""
    return preds.join(emails.select(F.col("id").alias("email_id")), "email_id", "left_anti")


def retention(emails: DataFrame, preds: DataFrame, activity: DataFrame, as_of: str, days: int = 90):
    """Drop activity and predictions older than the cutoff (strict <), then old mails with no
    remaining prediction. Returns the three kept tables; the caller writes them to new paths."""
    cut = cutoff(as_of, days=days)
    kept_activity = activity.filter(F.col("timestamp") >= cut)
    kept_preds = preds.filter(F.col("timestamp") >= cut)
    referenced = kept_preds.filter(F.col("email_id").isNotNull()).select(F.col("email_id").alias("id")).distinct()
    marked = emails.join(referenced.withColumn("_used", F.lit(True)), "id", "left")
    kept_emails = marked.filter((F.col("timestamp") >= cut) | F.col("_used")).drop("_used")
    return kept_emails, kept_preds, kept_activity


def retention_counts(emails: DataFrame, preds: DataFrame, activity: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Number of rows deleted per table (three one-row aggregates, no join)."""
    cut = cutoff(as_of, days=days)
    referenced = preds.filter((F.col("timestamp") >= cut) & F.col("email_id").isNotNull()) \
        .select(F.col("email_id").alias("id")).distinct()
    doomed = emails.filter(F.col("timestamp") < cut).join(referenced, "id", "left_anti")

    def n(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("bigint").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")

    return n("user_activity", activity.filter(F.col("timestamp") < cut)) \
        .unionByName(n("predictions", preds.filter(F.col("timestamp") < cut))) \
        .unionByName(n("emails", doomed))


def retention_cascade(emails_kept: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions that survive the mail deletion (ON DELETE CASCADE as a semi join)."""
    return preds.join(emails_kept.select(F.col("id").alias("email_id")), "email_id", "left_semi")
