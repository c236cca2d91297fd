"""The analytics tables (emails, predictions, activity, tracker, feedback) as the scoring job writes them, derived from the
driver tables through the library's own operators, and the store that reports read them from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal.operators import parse, score
from mailsignal.session import scratch_path
from mailsignal.sources import views
from mailsignal.sources.store import LogStore, fingerprint


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emails`` table (A4) from the raw mails."""
    return parse.emails_table(views.raw_mails(spark, sf_dir))


def scored_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mails that are not blank, with rule analysis, stand-in model outputs and the ensemble."""
    m = score.not_blank(views.raw_mails(spark, sf_dir), "raw_text")
    m = score.analyze(m, "raw_text")
    p_rf, p_svm = views.stand_in_scores(F.col("email_id"))
    m = m.select("*", *score.model_result(p_rf, "rf"), *score.model_result(p_svm, "svm"))
    return score.ensemble(m).withColumn("predicted_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` log (A5): three rows for each mail that is not blank. A few rows carry a null or an unknown mail id, as a log written
    by independent requests can."""
    p = score.fan_out(scored_mails(spark, sf_dir))
    eid = F.col("email_id")
    bad = (F.when(eid % 103 == 0, F.lit(None).cast("bigint"))
            .when(eid % 101 == 0, -eid - 1).otherwise(eid))
    return p.withColumn("email_id", bad)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_activity`` log (A6): session key from day and client, client from the forwarded list."""
    r = views.activity_requests(spark, sf_dir)
    ip = score.client_ip("x_forwarded_for", "remote_addr")
    day_start = F.date_trunc("day", F.col("timestamp"))
    sess = F.md5(F.concat_ws("|", F.date_format(day_start, "yyyy-MM-dd'T'HH:mm:ss"), ip))
    return r.select(
        "id", sess.alias("session_id"), "action",
        F.col("email_hash").alias("email_content_hash"),
        F.when(F.col("action").isin("error", "click"), F.lit("Phishing"))
         .when(F.col("action").isin("view", "purchase"), F.lit("Legitimate")).alias("prediction_result"),
        F.col("timestamp"), ip.alias("ip_address"), "user_agent",
    )


tracker = views.tracker
feedback = views.feedback


TABLES = {"emails": emails, "user_activity": activity, "predictions": predictions, "tracker": tracker}


def store(spark: SparkSession, sf_dir: str, *tables: str) -> LogStore:
    """The stored logs of the mails and events under ``sf_dir``, with the named tables (none: all). The folder's name tells the input files, and
    a table is appended once, so the first report of a session that reads it fills it and the others read it."""
    key = fingerprint(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet")
    out = LogStore(spark, scratch_path(spark, "logs", key))
    state = out.snapshot()
    new = {t: TABLES[t](spark, sf_dir) for t in tables or TABLES if "load" not in state.get(t, {}).get("batches", {})}
    if new:
        out.append("load", **new)
    return out


def stored(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return store(spark, sf_dir, table).read(table)
