"""Feature frames as single projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal import lexicon as L
from mailsignal.functions import features as E


def metadata_frame(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Old-stack metadata columns; which ones exist depends on the input columns (decided at
    plan-build time): text length and words from processed_text when present, subject and sender
    features only when those columns exist."""
    cols = [F.col(id_col)] if id_col else []
    base = "processed_text" if "processed_text" in df.columns else ("text" if "text" in df.columns else None)
    if base:
        cols += [E.char_count(base).alias("text_length"), E.word_count(base).alias("word_count")]
    if "subject" in df.columns:
        s = F.coalesce(F.col("subject"), F.lit(""))
        cols += [E.char_count(s).alias("subject_length"),
                 E.count_substr(s, "!").alias("subject_exclamation_count"),
                 E.count_substr(s, "?").alias("subject_question_count"),
                 F.round(E.caps_ratio(s), 9).alias("subject_caps_ratio")]
    t = "text" if "text" in df.columns else ("processed_text" if "processed_text" in df.columns else None)
    if t:
        cols += [E.url_count_escaped(t).alias("url_count"),
                 E.has_ip_bounded(t).alias("has_ip_url"),
                 E.has_shortener_in_text(t).alias("has_shortened_url")]
    if "sender" in df.columns:
        cols += [E.sender_suspicious("sender").alias("sender_suspicious")]
    if t:
        cols += [E.keyword_hits(t, L.KEYWORDS_20).alias("suspicious_keyword_count"),
                 E.keyword_hits(t, L.URGENCY_10).alias("urgency_indicators"),
                 E.count_substr(t, "!").alias("exclamation_count"),
                 E.count_substr(t, "?").alias("question_count"),
                 F.round(E.caps_ratio(t), 9).alias("caps_ratio")]
    return df.select(*cols)


def email_feature_dict(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The batch feature dict of one mail, as columns for every mail."""
    t = F.col(text_col)
    urls = E.url_list(t)
    return df.select(
        id_col,
        E.char_count(t).alias("char_count"),
        E.word_count(t).alias("word_count"),
        E.sentence_count(t).alias("sentence_count"),
        F.size(urls).cast("bigint").alias("url_count"),
        E.has_shortener_in_urls(urls).alias("has_shortened_url"),
        E.has_ip_loose(t).alias("has_ip_address"),
        E.caps_runs(t).alias("excessive_caps"),
        E.count_substr(t, "!").alias("exclamation_count"),
        E.count_substr(t, "?").alias("question_count"),
        E.keyword_hits(t, L.KEYWORDS_10).alias("suspicious_keyword_count"),
    )
