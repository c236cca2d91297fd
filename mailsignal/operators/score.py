"""Scoring: admissibility, rule analysis (risk score, indicators), per-model
results, the ensemble decision and the prediction-log fan-out.

Everything here is a per-row projection: no shuffle, so it scales with the
number of executors and runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsignal import lexicon as L
from mailsignal.functions import features as E
from mailsignal.functions.text import URL_NONSPACE
from mailsignal.operators.parse import strip_ws


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reject_reason(text_col: str = "text", max_len: int = L.MAX_EMAIL_LENGTH) -> Column:
    """Why the request form refuses a mail (B1-B3): empty after trim (or missing), too long; null if fine.
    The limit belongs to the form alone: batch and stream scoring take every mail that is not blank."""
    t = strip_ws(text_col)
    return F.when(F.length(t) == 0, F.lit(L.REJECT_EMPTY)).when(F.length(t) > max_len, F.lit(L.REJECT_LONG))


def not_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The mails that are scored: all but blank ones, trimmed."""
    return df.withColumn(text_col, strip_ws(text_col)).filter(F.length(text_col) > 0)


def admissible(df: DataFrame, text_col: str = "text", max_len: int = L.MAX_EMAIL_LENGTH) -> DataFrame:
    """Keep requests that pass B1/B2; the text is replaced by its trimmed form."""
    return (df.withColumn(text_col, strip_ws(text_col))
              .filter((F.length(text_col) > 0) & (F.length(text_col) <= max_len)))


def rejected(df: DataFrame, text_col: str = "text", max_len: int = L.MAX_EMAIL_LENGTH) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(text_col, max_len)).filter(F.col("reject_reason").isNotNull())


def analyze(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rule analysis (I4-I6): URL count, found keywords, risk score, indicator list."""
    t = F.col(text_col)
    n_urls = F.regexp_count(t, F.lit(URL_NONSPACE)).cast("bigint")
    out = (df.withColumn("url_count", n_urls)
             .withColumn("found_keywords", E.found_keywords(t, L.KEYWORDS_20)))
    n_kw = F.size("found_keywords").cast("bigint")
    indicators = F.array_compact(F.array(
        F.when(F.col("url_count") > 0, F.concat(F.lit("Contains "), F.col("url_count").cast("string"), F.lit(" URL(s)"))),
        F.when(n_kw > 0, F.concat(F.lit("Suspicious keywords: "),
                                  F.array_join(F.slice("found_keywords", 1, 5), ", "))),
    ))
    return (out.withColumn("suspicious_keyword_count", n_kw)
               .withColumn("risk_score", F.least(F.lit(100), F.col("url_count") * 10 + n_kw * 8).cast("bigint"))
               .withColumn("suspicious_indicators", indicators)
               .withColumn("character_count", E.char_count(t))
               .withColumn("word_count", E.word_count(t)))


def risk_band(score) -> Column:
    """Display band of a 0-100 risk score (I7): >70 danger, >40 warning, else success."""
    s = _c(score)
    return (F.when(s > L.HIGH_RISK, F.lit("danger"))
             .when(s > L.WARN_RISK, F.lit("warning")).otherwise(F.lit("success")))


def label_text(pred) -> Column:
    return F.when(_c(pred) == 1, F.lit("Phishing")).otherwise(F.lit("Legitimate"))


def model_result(p_phishing, prefix: str) -> list[Column]:
    """Per-model columns (I2): prediction, label, confidence of the predicted class, both probabilities."""
    p = _c(p_phishing)
    pred = F.when(p > 0.5, F.lit(1)).otherwise(F.lit(0))
    return [
        pred.alias(f"{prefix}_prediction"),
        label_text(pred).alias(f"{prefix}_label"),
        F.when(pred == 1, p).otherwise(F.lit(1.0) - p).alias(f"{prefix}_confidence"),
        (F.lit(1.0) - p).alias(f"{prefix}_probability_legitimate"),
        p.alias(f"{prefix}_probability_phishing"),
    ]


def ensemble(df: DataFrame, primary: str = "rf", secondary: str = "svm") -> DataFrame:
    """Ensemble decision (I3): the primary model's prediction and confidence win;
    agreement = both predictions equal; with one model only, that model and agreement true."""
    pp, sp = F.col(f"{primary}_prediction"), F.col(f"{secondary}_prediction")
    pc, sc = F.col(f"{primary}_confidence"), F.col(f"{secondary}_confidence")
    pred = F.coalesce(pp, sp)
    return (df.withColumn("ensemble_prediction", pred)
              .withColumn("ensemble_label", label_text(pred))
              .withColumn("ensemble_confidence", F.when(pp.isNotNull(), pc).otherwise(sc))
              .withColumn("ensemble_agreement", F.when(pp.isNotNull() & sp.isNotNull(), pp == sp)
                          .otherwise(F.lit(True))))


def fan_out(df: DataFrame, id_col: str = "email_id", ts_col: str = "predicted_at") -> DataFrame:
    """Prediction-log rows (A5): one per model plus one ``ensemble`` row whose probabilities are 0.0;
    risk score and indicators repeated on each. ``inline`` of a 3-element array: no shuffle."""
    def row(idx: int, name: str, prefix: str, probs: bool) -> Column:
        return F.struct(
            F.lit(idx).alias("k"),
            F.lit(name).alias("model_name"),
            F.col(f"{prefix}_prediction").alias("prediction"),
            F.col(f"{prefix}_label").alias("prediction_label"),
            F.col(f"{prefix}_confidence").alias("confidence"),
            (F.col(f"{prefix}_probability_legitimate") if probs else F.lit(0.0)).alias("probability_legitimate"),
            (F.col(f"{prefix}_probability_phishing") if probs else F.lit(0.0)).alias("probability_phishing"),
        )
    rows = F.array(row(0, "random_forest", "rf", True), row(1, "svm", "svm", True), row(2, "ensemble", "ensemble", False))
    out = df.select(F.col(id_col).alias("email_id"), F.col("risk_score"), F.col("suspicious_indicators"),
                    F.col(ts_col).alias("timestamp"), F.inline(rows))
    return out.select(
        (F.col("email_id") * 3 + F.col("k")).alias("id"),
        "email_id", "model_name", F.col("prediction").cast("int").alias("prediction"), "prediction_label",
        "confidence", "probability_legitimate", "probability_phishing",
        F.col("risk_score").cast("double").alias("risk_score"), "suspicious_indicators", "timestamp",
    )


def email_hash(text_col: str = "text") -> Column:
    """First 10 hex digits of SHA-256 of the (trimmed) text (I8)."""
    return F.substring(F.sha2(F.col(text_col), 256), 1, 10)


def session_key(ts_col: str, ip_col: str) -> Column:
    """MD5 of 'ISO time|client address' (I9)."""
    iso = F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss")
    return F.md5(F.concat_ws("|", iso, F.col(ip_col)))


def client_ip(fwd_col: str = "x_forwarded_for", peer_col: str = "remote_addr") -> Column:
    """First forwarded address, trimmed; else the peer; else 'unknown' (I10)."""
    fwd = F.coalesce(F.col(fwd_col), F.lit(""))
    first = F.trim(F.split(fwd, ",").getItem(0))
    return F.when(fwd != "", first).otherwise(F.coalesce(F.col(peer_col), F.lit("unknown")))
