"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsignal import lexicon as L
from mailsignal.functions import features as E
from mailsignal.functions import text as T
from mailsignal.operators import analytics as K
from mailsignal.operators import dictionary as D
from mailsignal.operators import matching as X
from mailsignal.operators import parse as C
from mailsignal.operators import retention as R
from mailsignal.operators import score as S
from mailsignal.sources import logs, views
from mailsignal.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


MAIL_AS_OF = views.MAIL_AS_OF
TRACKER_AS_OF = views.TRACKER_AS_OF


# -- flagship -------------------------------------------------------------------------

@query
def risk_report(spark, sf_dir):
    """Mails -> rule analysis -> risk band; per band: mails, mean risk, mails with URLs."""
    m = S.analyze(S.not_blank(views.raw_mails(spark, sf_dir), "raw_text"), "raw_text")
    return (m.withColumn("band", S.risk_band("risk_score"))
            .groupBy("band")
            .agg(F.count(F.lit(1)).cast("bigint").alias("mails"),
                 K.round_avg("risk_score", 6).alias("avg_risk"),
                 F.count(F.when(F.col("url_count") > 0, 1)).cast("bigint").alias("mails_with_urls"),
                 F.max("risk_score").alias("max_risk")))


@query
def top_risk_mails(spark, sf_dir):
    """Top 20 mails by risk score (ties by id): the report's top-k list."""
    m = S.analyze(S.not_blank(views.raw_mails(spark, sf_dir), "raw_text"), "raw_text")
    return (m.orderBy(F.desc("risk_score"), "email_id").limit(20)
            .select("email_id", "risk_score", S.risk_band("risk_score").alias("band"),
                    F.array_join("suspicious_indicators", "; ").alias("indicators")))


# -- admission (B1-B3) ----------------------------------------------------------------

@query
def admissible_emails(spark, sf_dir):
    m = S.admissible(views.raw_mails(spark, sf_dir), "raw_text")
    return m.select("email_id", F.length("raw_text").cast("bigint").alias("n_chars"), "label")


@query
def rejected_emails(spark, sf_dir):
    r = S.rejected(views.raw_mails(spark, sf_dir), "raw_text")
    return r.select("email_id", "reject_reason")


# -- parsing (C1-C6) ------------------------------------------------------------------

@query
def email_headers(spark, sf_dir):
    p = C.split_headers(views.raw_mails(spark, sf_dir))
    return p.select("email_id", "subject", "sender", "receiver", "date",
                    F.length("body").cast("bigint").alias("body_chars"),
                    F.md5("body").alias("body_md5"))


@query
def sender_address(spark, sf_dir):
    p = C.split_headers(views.raw_mails(spark, sf_dir))
    return p.select("email_id", C.address_name("sender").alias("sender_name"),
                    C.address_email("sender").alias("sender_email"))


@query
def url_list(spark, sf_dir):
    p = C.parse_mails(views.raw_mails(spark, sf_dir))
    return p.select("email_id", F.array_join("urls", " ").alias("urls"), F.size("urls").cast("bigint").alias("n_urls"))


@query
def url_hosts(spark, sf_dir):
    p = C.parse_mails(views.raw_mails(spark, sf_dir))
    return C.url_hosts(p).select("email_id", F.col("pos").cast("bigint").alias("pos"), "url", "host")


@query
def emails_table(spark, sf_dir):
    e = logs.emails(spark, sf_dir)
    return e.select("id", "sender_email", "sender_name", "receiver_email", "subject",
                    F.md5("body").alias("body_md5"), F.md5("processed_text").alias("processed_md5"),
                    F.array_join("urls", " ").alias("urls"), "timestamp")


# -- logs (A5-A7) ---------------------------------------------------------------------

@query
def prediction_fanout(spark, sf_dir):
    p = logs.stored(spark, sf_dir, "predictions").drop("day", "batch")
    return p.withColumn("suspicious_indicators", F.array_join("suspicious_indicators", "; "))


@query
def activity_log(spark, sf_dir):
    return logs.stored(spark, sf_dir, "user_activity").drop("day", "batch")


@query
def tracker_correct_flag(spark, sf_dir):
    return logs.stored(spark, sf_dir, "tracker").select("id", "prediction", "actual_label", "correct")


# -- scoring (I2-I10) -----------------------------------------------------------------

@query
def model_result(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)
    cols = [f"{m}_{k}" for m in ("rf", "svm")
            for k in ("prediction", "label", "confidence", "probability_legitimate", "probability_phishing")]
    return s.select("email_id", *cols)


@query
def ensemble_vote(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)
    return s.select("email_id", "ensemble_prediction", "ensemble_label", "ensemble_confidence", "ensemble_agreement")


@query
def risk_score(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)
    return s.select("email_id", "risk_score", "url_count", "suspicious_keyword_count", "character_count", "word_count")


@query
def risk_indicators(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)
    return s.select("email_id", F.array_join("suspicious_indicators", "; ").alias("indicators"),
                    F.size("suspicious_indicators").cast("bigint").alias("n_indicators"))


@query
def risk_band(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)
    return s.groupBy(S.risk_band("risk_score").alias("band")).agg(F.count(F.lit(1)).cast("bigint").alias("mails"))


@query
def email_hash(spark, sf_dir):
    m = S.not_blank(views.raw_mails(spark, sf_dir), "raw_text")
    return m.select("email_id", S.email_hash("raw_text").alias("email_hash"))


@query
def session_key(spark, sf_dir):
    r = views.activity_requests(spark, sf_dir).withColumn("client", S.client_ip())
    return r.select("id", S.session_key("timestamp", "client").alias("session_id"))


@query
def client_ip(spark, sf_dir):
    r = views.activity_requests(spark, sf_dir)
    return r.select("id", S.client_ip().alias("client_ip"))


# -- tracker analytics (K1-K5) --------------------------------------------------------

@query
def tracker_overall(spark, sf_dir):
    return K.tracker_overall(logs.tracker(spark, sf_dir))


@query
def tracker_recent(spark, sf_dir):
    return K.tracker_recent(logs.tracker(spark, sf_dir), TRACKER_AS_OF, hours=24)


@query
def class_breakdown(spark, sf_dir):
    return K.class_breakdown(logs.tracker(spark, sf_dir), TRACKER_AS_OF, hours=24 * 7)


@query
def confidence_bins(spark, sf_dir):
    return K.confidence_bins(logs.tracker(spark, sf_dir), TRACKER_AS_OF, hours=24 * 7)


@query
def accuracy_trend(spark, sf_dir):
    return K.accuracy_trend(logs.tracker(spark, sf_dir), TRACKER_AS_OF, days=31)


# -- the same reports from rollups: partial sums of three batches of the logs, one of them late, and of the corrections by feedback ---

def _rolled(spark, sf_dir):
    """(stored logs, store of their partial sums, tracker after feedback)."""
    from mailsignal.operators import rollup as U
    from mailsignal.sources.store import LogStore
    base = logs.store(spark, sf_dir, "predictions", "tracker")
    out = LogStore(spark, base.root + "-rolled")
    preds, tracked = (base.read(t).drop("day", "batch") for t in ("predictions", "tracker"))
    corrected = R.feedback_apply(tracked, logs.feedback(spark, sf_dir))
    if "feedback" in out.snapshot().get("tracker_hours", {}).get("batches", {}):
        return base, out, corrected
    late = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    p, t = F.col("timestamp") < K.cutoff(MAIL_AS_OF, days=60), F.col("timestamp") < K.cutoff(TRACKER_AS_OF, days=15)
    for name, some, others in (("older", p & ~late, t & ~late), ("newer", ~p & ~late, ~t & ~late), ("late", late, late)):
        out.append(name, prediction_days=U.prediction_days(preds.where(some)), tracker_hours=U.tracker_hours(tracked.where(others)))
    changed = corrected.join(tracked.select("id", F.col("correct").alias("was"), F.col("actual_label").alias("old")), "id").where(
        ~F.col("correct").eqNullSafe(F.col("was")) | ~F.col("actual_label").eqNullSafe(F.col("old"))).drop("was", "old")
    out.append("feedback", tracker_hours=U.difference(tracked.join(changed.select("id"), "id", "left_semi"), changed))
    return base, out, corrected


@query
def rollup_overall(spark, sf_dir):
    """K1 after feedback, from the partial sums."""
    from mailsignal.operators import rollup as U
    return U.overall(_rolled(spark, sf_dir)[1].read("tracker_hours"))


@query
def rollup_recent(spark, sf_dir):
    """K2 after feedback, from the partial sums; the window begins within an hour."""
    from mailsignal.operators import rollup as U
    _, store, corrected = _rolled(spark, sf_dir)
    return U.recent(U.window_sums(store.read("tracker_hours"), corrected, "2024-01-20 12:34:56", 24))


@query
def rollup_class_breakdown(spark, sf_dir):
    """K3 from the partial sums."""
    from mailsignal.operators import rollup as U
    _, store, corrected = _rolled(spark, sf_dir)
    return U.by_class(U.window_sums(store.read("tracker_hours"), corrected, TRACKER_AS_OF, 24 * 7))


@query
def rollup_confidence_bins(spark, sf_dir):
    """K4 from the partial sums."""
    from mailsignal.operators import rollup as U
    _, store, corrected = _rolled(spark, sf_dir)
    return U.bins(U.window_sums(store.read("tracker_hours"), corrected, TRACKER_AS_OF, 24 * 7))


@query
def rollup_accuracy_trend(spark, sf_dir):
    """K5 after feedback, from the partial sums."""
    from mailsignal.operators import rollup as U
    return U.trend(_rolled(spark, sf_dir)[1].read("tracker_hours"), TRACKER_AS_OF, days=31)


@query
def rollup_model_daily(spark, sf_dir):
    """K8 from the partial sums."""
    from mailsignal.operators import rollup as U
    base, store, _ = _rolled(spark, sf_dir)
    return U.model_daily(store.read("prediction_days"), base.read("predictions"), MAIL_AS_OF, days=30)


@query
def rollup_daily_statistics(spark, sf_dir):
    """K9 from the partial sums."""
    from mailsignal.operators import rollup as U
    base, store, _ = _rolled(spark, sf_dir)
    return U.daily(store.read("prediction_days"), base.read("predictions"), MAIL_AS_OF, days=90)


# -- prediction-log analytics (K6-K10, L1-L2) -----------------------------------------

@query
def prediction_statistics(spark, sf_dir):
    return K.prediction_statistics(logs.stored(spark, sf_dir, "predictions"), MAIL_AS_OF, days=30)


@query
def model_performance(spark, sf_dir):
    return K.model_performance(logs.stored(spark, sf_dir, "predictions"))


@query
def model_daily_summary(spark, sf_dir):
    return K.model_daily_summary(logs.stored(spark, sf_dir, "predictions"), MAIL_AS_OF, days=30)


@query
def daily_statistics(spark, sf_dir):
    return K.daily_statistics(logs.stored(spark, sf_dir, "predictions"), MAIL_AS_OF, days=90)


@query
def recent_phishing(spark, sf_dir):
    return K.recent_phishing(logs.stored(spark, sf_dir, "emails"), logs.stored(spark, sf_dir, "predictions"), MAIL_AS_OF, days=30)


@query
def recent_predictions(spark, sf_dir):
    return K.recent_predictions(logs.stored(spark, sf_dir, "emails"), logs.stored(spark, sf_dir, "predictions"), limit=50)


@query
def model_titles(spark, sf_dir):
    p = logs.stored(spark, sf_dir, "predictions").select("model_name").distinct()
    return K.model_titles(p)


# -- feedback, retention, referential checks (M1, N1, N2, L3, L8, L9, B8) --------------

@query
def latest_prediction(spark, sf_dir):
    return R.latest_prediction(logs.tracker(spark, sf_dir))


@query
def feedback_apply(spark, sf_dir):
    return R.feedback_apply(logs.tracker(spark, sf_dir), logs.feedback(spark, sf_dir))


@query
def feedback_unmatched(spark, sf_dir):
    return R.feedback_unmatched(logs.tracker(spark, sf_dir), logs.feedback(spark, sf_dir)) \
        .select("feedback_id", "email_hash", "actual_label")


@query
def feedback_valid(spark, sf_dir):
    """Feedback requests decoded from the event payloads; invalid ones dropped."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "props")
    k = F.get_json_object("props", "$.k")
    req = e.select("event_id",
                   F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(
                       F.substring(F.md5(F.col("user_id").cast("string")), 1, 10)).alias("email_hash"),
                   F.when(k.cast("int") % 3 == 0, F.lit(None)).when(k.cast("int") % 3 == 1, F.lit("x"))
                    .otherwise((k.cast("int") % 2).cast("string")).alias("actual_label"))
    return R.feedback_valid(req)


@query
def orphan_emails(spark, sf_dir):
    """L3 on the whole log."""
    preds = logs.stored(spark, sf_dir, "predictions")
    return R.orphan_emails(logs.stored(spark, sf_dir, "emails"), preds, MAIL_AS_OF, days=90).select("id", "timestamp")


@query
def orphan_predictions(spark, sf_dir):
    return R.orphan_predictions(logs.stored(spark, sf_dir, "emails"), logs.stored(spark, sf_dir, "predictions")) \
        .select("id", "email_id", "model_name")


def _cleaned(spark, sf_dir):
    """The stored logs, and a branch of them after a clean-up of 90 days (done once)."""
    full = logs.store(spark, sf_dir)
    mine = full.fork("cleaned")
    mine.retention(MAIL_AS_OF, days=90)
    return full, mine


@query
def retention_keep(spark, sf_dir):
    """The mails that the rewritten store still holds."""
    return _cleaned(spark, sf_dir)[1].read("emails").select("id", "timestamp")


@query
def retention_counts(spark, sf_dir):
    """Rows deleted per table, by what the store held before and holds after its clean-up."""
    full, mine = _cleaned(spark, sf_dir)
    out = None
    for t in ("user_activity", "predictions", "emails"):
        n = lambda store, sign: store.read(t).agg((sign * F.count(F.lit(1))).alias("n"))  # noqa: E731,B023
        one = n(full, 1).unionByName(n(mine, -1)).agg(F.sum("n").cast("bigint").alias("deleted")).select(F.lit(t).alias("table_name"), "deleted")
        out = one if out is None else out.unionByName(one)
    return out


@query
def retention_cascade(spark, sf_dir):
    """Predictions left in the rewritten store whose mail is left as well."""
    mine = _cleaned(spark, sf_dir)[1]
    return R.retention_cascade(mine.read("emails"), mine.read("predictions")).select("id", "email_id", "model_name")


# -- dictionaries (L4, L5) ------------------------------------------------------------

@query
def keyword_hits(spark, sf_dir):
    m = views.raw_mails(spark, sf_dir)
    return X.keyword_hits(m, D.keyword_dimension(spark), "raw_text")


@query
def keyword_category_score(spark, sf_dir):
    m = views.raw_mails(spark, sf_dir)
    return D.keyword_category_score(X.keyword_hits(m, D.keyword_dimension(spark), "raw_text"))


@query
def url_pattern_hits(spark, sf_dir):
    p = C.url_hosts(C.parse_mails(views.raw_mails(spark, sf_dir)))
    hits = X.pattern_hits(p, D.url_pattern_dimension(spark), "url")
    return (hits.groupBy("email_id", "pos", "pattern_type")
            .agg(F.count(F.lit(1)).cast("bigint").alias("hits"), F.round(F.sum("weight"), 6).alias("weight"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def corpus_dictionary(spark, sf_dir):
    """A keyword table taken from the corpus: its words of nine letters and more, upserted with those of the conversations, which are
    switched off there."""
    def words(name):
        found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
        return load(spark, sf_dir, name).select(F.explode(found).alias("keyword")).where("length(keyword) >= 9").distinct()
    base = words("documents").select("keyword", F.left("keyword", F.lit(1)).alias("category"), (F.length("keyword") / 4).alias("weight"), F.lit(True).alias("is_active"))
    return D.upsert(base, words("conversations").select("keyword", F.lit("talk").alias("category"), F.lit(1.0).alias("weight"), F.lit(False).alias("is_active")), "keyword", ["is_active"])


def _dictionary_score(spark, sf_dir, limit):
    hits = X.keyword_hits(views.raw_mails(spark, sf_dir), corpus_dictionary(spark, sf_dir), "raw_text", limit=limit)
    return D.keyword_category_score(hits)


@query
def dictionary_hits(spark, sf_dir):
    """Mails against a dictionary of the corpus's size: hits and weight per mail and category."""
    return _dictionary_score(spark, sf_dir, None)


@query
def dictionary_hits_joined(spark, sf_dir):
    """The same for a dictionary too large to send to every task (the limit is set to 0 bytes here): by a join."""
    return _dictionary_score(spark, sf_dir, 0)


# -- text (D1-D4, D6, D8-D11) -----------------------------------------------------------

def _mails(spark, sf_dir):
    return views.raw_mails(spark, sf_dir)


@query
def clean_text(spark, sf_dir):
    return _mails(spark, sf_dir).select("email_id", T.clean_text("raw_text").alias("clean_text"))


@query
def html_to_text(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", T.html_to_text("html").alias("text"))


@query
def light_clean(spark, sf_dir):
    return _mails(spark, sf_dir).select("email_id", T.light_clean("raw_text").alias("light_text"))


@query
def tokens(spark, sf_dir):
    t = T.tokens(T.clean_text("raw_text"))
    return _mails(spark, sf_dir).select("email_id", F.size(t).cast("bigint").alias("n_tokens"),
                                        F.array_join(t, " ").alias("tokens"))


@query
def stopword_filter(spark, sf_dir):
    t = T.drop_stopwords(T.tokens(T.clean_text("raw_text")))
    return _mails(spark, sf_dir).select("email_id", F.size(t).cast("bigint").alias("n_tokens"),
                                        F.array_join(t, " ").alias("tokens"))


@query
def lemma_lookup(spark, sf_dir):
    """D6 with a lemma table derived from the corpus: a token ending in 's' (not 'ss') maps to
    the token without it when that form also occurs in the corpus."""
    import uuid
    from mailsignal.operators.textjobs import corpus_plural_lemmas, lemmatize, plural
    from mailsignal.session import scratch_path
    m = _mails(spark, sf_dir).select("email_id", T.drop_stopwords(T.tokens(T.clean_text("raw_text"))).alias("toks"))
    path = scratch_path(spark, "tokens", uuid.uuid4().hex)   # cleaned once, read by the lemma table, the lookup and the result
    m.write.parquet(path)
    m = spark.read.schema(m.schema).parquet(path)
    lem = corpus_plural_lemmas(m, "toks")
    out = lemmatize(m, "toks", lem, "email_id", plural)
    return out.select("email_id", F.array_join("lemmas", " ").alias("lemmas"))


@query
def accent_fold(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", T.accent_fold("text").alias("folded"))


@query
def word_ngrams(spark, sf_dir):
    toks = _mails(spark, sf_dir).select(
        "email_id", T.drop_stopwords(T.vector_tokens(T.light_clean("raw_text")), min_len=1).alias("toks"))
    g = toks.select("email_id", T.with_bigrams("toks").alias("g"))
    return g.select("email_id", F.size("g").cast("bigint").alias("n_terms"), F.array_join("g", "|").alias("terms"))


@query
def vector_tokens(spark, sf_dir):
    v = T.vector_tokens(T.light_clean("raw_text"))
    return _mails(spark, sf_dir).select("email_id", F.size(v).cast("bigint").alias("n_tokens"),
                                        F.array_join(v, " ").alias("tokens"))


@query
def corpus_preprocess(spark, sf_dir):
    """D8 (unstemmed) + B4: processed text, raw length, processed word count, URL count; empty dropped."""
    m = _mails(spark, sf_dir)
    processed = F.array_join(T.drop_stopwords(T.tokens(T.clean_text("raw_text"))), " ")
    out = m.select("email_id", "label", processed.alias("processed_text"),
                   E.char_count("raw_text").alias("email_length"),
                   E.url_count_range("raw_text").alias("url_count"))
    out = out.withColumn("word_count", F.size(T.tokens("processed_text")).cast("bigint"))
    return out.filter(F.length("processed_text") > 0)


# -- scalar features (E1-E21) -------------------------------------------------------------

@query
def text_stats(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.char_count(t).alias("char_count"),
                                        E.word_count(t).alias("word_count"),
                                        E.sentence_count(t).alias("sentence_count"))


@query
def url_counts(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.url_count_range(t).alias("url_count_extract"),
                                        E.url_count_escaped(t).alias("url_count_escaped"),
                                        E.url_count_http(t).alias("url_count_http"),
                                        E.url_count_nonspace(t).alias("url_count_nonspace"))


@query
def punct_counts(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.count_substr(t, "!").alias("exclamation_count"),
                                        E.count_substr(t, "?").alias("question_count"),
                                        E.count_substr(t, "$").alias("dollar_count"))


@query
def caps_features(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.caps_runs(t).alias("excessive_caps"),
                                        E.upper_count(t).alias("upper_count"),
                                        F.round(E.caps_ratio(t), 9).alias("caps_ratio"))


@query
def ip_flags(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.has_ip_loose(t).alias("has_ip_address"),
                                        E.has_ip_bounded(t).alias("has_ip_url"))


@query
def shortener_flags(spark, sf_dir):
    m = _mails(spark, sf_dir).withColumn("urls", E.url_list("raw_text"))
    return m.select("email_id", E.has_shortener_in_urls("urls").alias("has_shortened_url"),
                    E.has_shortener_in_text("raw_text").alias("has_shortened_url_text"))


@query
def keyword_counts(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.keyword_hits(t, L.KEYWORDS_10).alias("suspicious_keyword_count"),
                                        E.keyword_hits(t, L.KEYWORDS_20).alias("configured_keyword_count"),
                                        E.keyword_hits(t, L.KEYWORDS_5).alias("suspicious_keywords"))


@query
def urgency_counts(spark, sf_dir):
    t = F.col("raw_text")
    return _mails(spark, sf_dir).select("email_id", E.keyword_hits(t, L.URGENT_4).alias("urgent_words"),
                                        E.keyword_hits(t, L.URGENCY_10).alias("urgency_indicators"))


@query
def processed_stats(spark, sf_dir):
    e = logs.emails(spark, sf_dir)
    return e.select("id", E.char_count("processed_text").alias("text_length"),
                    E.word_count("processed_text").alias("word_count"))


@query
def subject_features(spark, sf_dir):
    p = C.split_headers(_mails(spark, sf_dir))
    s = F.col("subject")
    return p.select("email_id", E.char_count(s).alias("subject_length"),
                    E.count_substr(s, "!").alias("subject_exclamation_count"),
                    E.count_substr(s, "?").alias("subject_question_count"),
                    F.round(E.caps_ratio(s), 9).alias("subject_caps_ratio"))


@query
def sender_suspicious(spark, sf_dir):
    p = C.split_headers(_mails(spark, sf_dir))
    return p.select("email_id", "sender", E.sender_suspicious("sender").alias("sender_suspicious"))


@query
def metadata_features(spark, sf_dir):
    return _mails(spark, sf_dir).select("email_id", *E.metadata_vector_columns("raw_text"))


@query
def metadata_features_full(spark, sf_dir):
    """The old-stack metadata frame (presence-dependent columns resolved at plan time)."""
    from mailsignal.operators.featureframe import metadata_frame
    p = C.split_headers(_mails(spark, sf_dir)).withColumnRenamed("raw_text", "text")
    return metadata_frame(p, id_col="email_id")


@query
def email_features(spark, sf_dir):
    """The batch feature dict as columns."""
    from mailsignal.operators.featureframe import email_feature_dict
    return email_feature_dict(_mails(spark, sf_dir), "raw_text", "email_id")


@query
def metadata_numeric(spark, sf_dir):
    """Coerce text columns to double, unparsable -> 0.0."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "props", "value")

    def num(c):
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return e.select("event_id",
                    F.get_json_object("props", "$.k").alias("k_text"),
                    F.col("value").cast("string").alias("value_text"), "event_type") \
        .select("event_id", num("k_text").alias("k"), num("value_text").alias("value"),
                num("event_type").alias("event_type_num"))


@query
def json_request_decode(spark, sf_dir):
    """Decode request JSON with defaults for missing fields (PERMISSIVE: malformed -> defaults). The
    event payloads, which hold ``k`` only, and one request per conversation turn, some without a text or a label
    and every 11th cut off."""
    e = load(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"))
    i = F.col("event_id")
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "turn", "text")
    body = F.to_json(F.struct(F.col("turn").alias("k"), F.when(i % 7 != 0, F.col("text")).alias("email_text"),
                              F.when(i % 3 != 0, (i % 2).cast("int")).alias("actual_label")))
    requests = turns.select("event_id", F.when(i % 11 == 0, F.substring(body, 1, 5)).otherwise(body).alias("body"))
    d = e.unionByName(requests).select("event_id", F.from_json("body", "k bigint, email_text string, actual_label int").alias("j"))
    return d.select("event_id", F.coalesce("j.k", F.lit(0)).cast("bigint").alias("k"),
                    F.coalesce("j.email_text", F.lit("")).alias("email_text"),
                    F.col("j.actual_label").alias("actual_label"))


@query
def percent_text(spark, sf_dir):
    """Confidence as percentage text with one decimal."""
    s = logs.scored_mails(spark, sf_dir)
    return s.select("email_id", F.format_string("%.1f%%", F.col("ensemble_confidence") * 100).alias("confidence_text"))


# -- vectorisation (F1-F5, F8, F9) ----------------------------------------------------------

def _corpus(spark, sf_dir):
    return views.raw_mails(spark, sf_dir).select("email_id", "raw_text", "label")


@query
def tfidf_vocabulary(spark, sf_dir):
    from mailsignal.operators import vectorize as V
    return V.fit_vocabulary(_corpus(spark, sf_dir), "email_id", "raw_text").select("term", "idx", "df", "total")


@query
def tfidf_weights(spark, sf_dir):
    from mailsignal.operators import vectorize as V
    c = _corpus(spark, sf_dir)
    return V.tfidf(c, V.fit_vocabulary(c, "email_id", "raw_text"), "email_id", "raw_text")


@query
def tfidf_transform(spark, sf_dir):
    """conversation turns vectorised with the vocabulary fitted on the mails (unseen terms dropped)."""
    from mailsignal.operators import vectorize as V
    vocab = V.fit_vocabulary(_corpus(spark, sf_dir), "email_id", "raw_text")
    conv = load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    return V.tfidf(conv, vocab, "msg_id", "text")


@query
def chi2_select(spark, sf_dir):
    from mailsignal.operators import vectorize as V
    c = _corpus(spark, sf_dir)
    w = V.tfidf(c, V.fit_vocabulary(c, "email_id", "raw_text"), "email_id", "raw_text", carry=("label",))
    s = V.chi2_scores(w, c).withColumn("chi2", F.round("chi2", 6))
    return V.select_k_best(s, 1000)


@query
def standard_scale(spark, sf_dir):
    from mailsignal.operators import vectorize as V
    m = _mails(spark, sf_dir).select("email_id", *E.metadata_vector_columns("raw_text"))
    out = V.standard_scale(m, E.METADATA_NAMES, "email_id")
    return out.select("email_id", *[F.round(c, 9).alias(c) for c in E.METADATA_NAMES])


# -- splitting and corpus (G1-G4, G6, G7) ------------------------------------------------------

@query
def stratified_split(spark, sf_dir):
    """G1 on the imbalanced ``toxic`` target of the labels table."""
    from mailsignal.operators import split as G
    lab = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return G.stratified_split(lab, "doc_id").select("doc_id", "label", "split")


@query
def split_then_fit(spark, sf_dir):
    """Split first, fit the vocabulary on the training mails only, vectorise the test mails."""
    from mailsignal.operators import split as G
    from mailsignal.operators import vectorize as V
    s = G.stratified_split(_corpus(spark, sf_dir), "email_id")
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    vocab = V.fit_vocabulary(train, "email_id", "raw_text")
    return V.tfidf(test, vocab, "email_id", "raw_text")


@query
def stratified_folds(spark, sf_dir):
    from mailsignal.operators import split as G
    return G.stratified_folds(_corpus(spark, sf_dir).select("email_id", "label"), "email_id", k=5)


@query
def shuffle_index(spark, sf_dir):
    from mailsignal.operators import split as G
    d = load(spark, sf_dir, "documents").select("doc_id")
    return G.shuffle_index(d, "doc_id")


@query
def class_weights(spark, sf_dir):
    from mailsignal.operators import split as G
    lab = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return G.class_weights(lab).select("doc_id", "label", "class_weight")


@query
def corpus_summary(spark, sf_dir):
    from mailsignal.operators import split as G
    return G.corpus_summary(_corpus(spark, sf_dir), "raw_text")


# -- evaluation (J1-J7) --------------------------------------------------------------------

def _eval(spark, sf_dir):
    s = logs.scored_mails(spark, sf_dir)

    def m(name, pred, score):
        return F.struct(F.lit(name).alias("model_name"), F.col(pred).alias("prediction"), F.col(score).alias("score"))
    return s.select("email_id", "label", "raw_text", F.inline(F.array(
        m("random_forest", "rf_prediction", "rf_probability_phishing"),
        m("svm", "svm_prediction", "svm_probability_phishing"),
        m("ensemble", "ensemble_prediction", "rf_probability_phishing"))))


@query
def binary_metrics(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    b = J.binary_metrics(_eval(spark, sf_dir), "model_name")
    return b.select("model_name", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query
def roc_auc(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    return J.roc_auc(_eval(spark, sf_dir), "model_name").withColumn("roc_auc", F.round("roc_auc", 9))


@query
def confusion_matrix(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    return J.confusion(_eval(spark, sf_dir), "model_name")


@query
def classification_report(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    return J.classification_report(_eval(spark, sf_dir), "model_name")


@query
def model_comparison(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    return J.model_comparison(_eval(spark, sf_dir), "model_name")


@query
def best_model_by_metric(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    comp = J.model_comparison(_eval(spark, sf_dir), "model_name")
    return J.best_model_by_metric(comp, "model_name", list(L.MODEL_NAMES))


@query
def metric_history(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    ev = _eval(spark, sf_dir)
    comp = J.model_comparison(ev, "model_name")
    return J.metric_history(comp, ev, "model_name", MAIL_AS_OF, notes="hold-out evaluation")


@query
def prediction_outcomes(spark, sf_dir):
    from mailsignal.operators import evaluate as J
    ev = _eval(spark, sf_dir).filter(F.col("model_name") == "ensemble")
    return J.prediction_outcomes(ev, "email_id", "raw_text")


# -- Spark ML (F6, F7, H1-H8, I1, A8, A9): results against the models' own tables ----------------

_TRAINED: dict = {}


def _once(spark, sf_dir, what, make):
    """``make()`` once per session and state of the input files: another result after the mails are written anew."""
    from mailsignal.sources.store import fingerprint
    key = (what, spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _TRAINED:
        _TRAINED[key] = make()
    return _TRAINED[key]


def trained(spark, sf_dir):
    """The ML keys share one training run."""
    from mailsignal.operators import models as H
    return _once(spark, sf_dir, "models", lambda: H.train(_corpus(spark, sf_dir), fitted=fitted(spark, sf_dir)))


def fitted(spark, sf_dir):
    """The split corpus and the vocabulary of its training part."""
    from mailsignal.operators import models as H
    return _once(spark, sf_dir, "features", lambda: H.fit_features(_corpus(spark, sf_dir)))


@query
def feature_assembly(spark, sf_dir):
    """the assembled features of every mail as (email_id, idx, value) rows."""
    from mailsignal.operators import models as H
    _, vocab, n_terms = fitted(spark, sf_dir)
    return H.assembled_rows(_corpus(spark, sf_dir), vocab, "email_id", "raw_text", n_terms) \
        .withColumn("value", F.round("value", 9))


@query
def feature_align(spark, sf_dir):
    """Conversation turns, vectorised with a vocabulary of their own, under the saved schema of the mails."""
    from mailsignal.operators import models as H
    from mailsignal.operators import vectorize as V
    conv = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    own = V.tfidf(conv, V.fit_vocabulary(conv, "msg_id", "text"), "msg_id", "text")
    return H.align(own.select("msg_id", F.col("term").alias("name"), F.col("weight").alias("value")), feature_schema(spark, sf_dir))


@query
def feature_counts(spark, sf_dir):
    from mailsignal.operators import models as H
    _, vocab, n_terms = fitted(spark, sf_dir)
    names = H.feature_names(vocab)
    return names.agg(F.count(F.when(F.col("idx") < n_terms, 1)).alias("tfidf_features"),
                     F.count(F.when(F.col("idx") >= n_terms, 1)).alias("metadata_features"),
                     F.count(F.lit(1)).alias("total_features"))


def _same(spark, sf_dir):
    """Test mails: Spark ML's results against the models' tables."""
    from mailsignal.operators import models as H
    t = trained(spark, sf_dir)
    return H.same_scores(t, t.test)


@query
def rf_fit_predict(spark, sf_dir):
    """H1: the fitted forest on the test mails; ``same`` where its node table gives Spark ML's class and probabilities."""
    return _same(spark, sf_dir).select("email_id", "label", F.col("rf_same").alias("same"))


@query
def svm_fit_predict(spark, sf_dir):
    """H2: the fitted linear SVM on the test mails; ``same`` where its weight table gives Spark ML's class."""
    return _same(spark, sf_dir).select("email_id", "label", F.col("svm_same").alias("same"))


@query
def svm_calibrated(spark, sf_dir):
    """H4: as ``svm_fit_predict``, with the calibrated probability."""
    return _same(spark, sf_dir).select("email_id", "label", F.col("platt_same").alias("same"))


@query
def score_emails(spark, sf_dir):
    """Trained models on every mail -> per-model results, ensemble, rule analysis; ``same`` where the models' tables give the
    same results and ensemble."""
    from mailsignal.operators import models as H
    t = trained(spark, sf_dir)
    s = H.same_scores(t, t.every)
    rules = S.analyze(_corpus(spark, sf_dir), "raw_text").select("email_id", "risk_score", F.array_join("suspicious_indicators", "; ").alias("indicators"))
    return s.join(rules, "email_id", "inner").select("email_id", "label", "risk_score", "indicators", (F.col("rf_same") & F.col("platt_same") & F.col("ensemble_same")).alias("same"))


@query
def training_job(spark, sf_dir):
    """H8: the whole training job's evaluation table on the held-out split (J5 on real models): per model its test mails, whether all metrics lie in
    [0, 1] and whether its accuracy beats guessing the larger class."""
    from mailsignal.operators import evaluate as J
    from mailsignal.operators import models as H
    t = trained(spark, sf_dir)
    s = H.score(t, t.test)

    def m(name, pred, sc):
        return F.struct(F.lit(name).alias("model_name"), F.col(pred).alias("prediction"), F.col(sc).alias("score"))
    ev = s.select("email_id", "label", F.inline(F.array(
        m("random_forest", "rf_prediction", "rf_probability_phishing"),
        m("svm", "svm_prediction", "svm_probability_phishing"),
        m("ensemble", "ensemble_prediction", "rf_probability_phishing"))))
    table = J.model_comparison(ev, "model_name").join(ev.groupBy("model_name").agg(F.count(F.lit(1)).alias("test_mails")), "model_name")
    inside = [F.col(c).between(0, 1) for c in J.METRICS]
    base = H.majority(t.test).first()   # one row
    return table.select("model_name", "test_mails", F.array_min(F.array(*inside)).alias("in_bounds"), (F.col("accuracy") > base["share"]).alias("above_majority"))


@query
def grid_search(spark, sf_dir):
    """H5: every setting of the grids; ``in_bounds`` where its mean F1 lies in [0, 1] and its spread in [0, 0.5], ``finds`` where the best
    setting of its model beats guessing the larger class."""
    from pyspark.sql import Window
    from mailsignal.operators import models as H
    scores = _once(spark, sf_dir, "grid", lambda: H.grid_search(trained(spark, sf_dir)).checkpoint(eager=True))
    base = H.majority(trained(spark, sf_dir).train).first()   # one row
    best = F.max("mean_f1").over(Window.partitionBy("model_name"))   # a row a setting
    return scores.withColumn("finds", best > base["f1"]).withColumn("in_bounds", F.col("mean_f1").between(0, 1) & F.col("std_f1").between(0, 0.5)).drop("mean_f1", "std_f1")


@query
def cv_summary(spark, sf_dir):
    """H6: fold F1 scores, mean and population std over 5 folds, for both models: mails, folds, whether the scores lie in [0, 1], mean and std
    are theirs, and the mean beats guessing the larger class."""
    from mailsignal.operators import models as H
    t = trained(spark, sf_dir)
    scores = _once(spark, sf_dir, "cv", lambda: H.cv_scores(t).checkpoint(eager=True))
    base = H.majority(t.train).first()   # one row
    each = scores.select("*", F.explode("fold_f1").alias("f1")).groupBy("model_name", "mean_f1", "std_f1").agg(
        F.count("f1").alias("folds"), F.avg("f1").alias("m"), F.stddev_pop("f1").alias("d"), F.min("f1").alias("low"), F.max("f1").alias("high"))
    return each.select("model_name", F.lit(base["n"]).cast("bigint").alias("mails"), "folds", ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("in_bounds"),
                       ((F.abs(F.col("m") - F.col("mean_f1")) < 1e-9) & (F.abs(F.col("d") - F.col("std_f1")) < 1e-9)).alias("adds_up"),
                       (F.col("mean_f1") > base["f1"]).alias("above_majority"))


@query
def svm_rff(spark, sf_dir):
    """H3: Gaussian-kernel SVM by random Fourier features, on every mail; ``same`` where its weight table gives Spark ML's class and probability."""
    from mailsignal.operators import models as H
    return H.same_kernel_scores(_once(spark, sf_dir, "kernel", lambda: H.fit_rbf(trained(spark, sf_dir))))


@query
def feature_importance(spark, sf_dir):
    """H7: importance of every feature; ``same`` where the forest's node table gives Spark ML's."""
    from mailsignal.operators import models as H
    return H.same_importances(trained(spark, sf_dir))


@query
def model_roundtrip(spark, sf_dir):
    """Save both fitted pipelines under the shared checkpoint folder, load, score every mail again."""
    import uuid
    from pyspark.ml import PipelineModel
    from mailsignal.operators import models as H
    from mailsignal.session import scratch_path
    t = trained(spark, sf_dir)
    base = scratch_path(spark, "models", uuid.uuid4().hex)
    for name, m in (("forest", t.forest), ("svm", t.svm), ("platt", t.platt)):
        m.write().overwrite().save(f"{base}/{name}")
    loaded = H.Trained(t.vocab, t.n_features, PipelineModel.load(f"{base}/forest"), PipelineModel.load(f"{base}/svm"),
                       PipelineModel.load(f"{base}/platt"), t.train, t.test, t.every)
    cols = ("ensemble_prediction", "rf_probability_phishing", "svm_probability_phishing")
    a = H.score(t, t.every).select("email_id", F.struct(*cols).alias("before"))
    b = H.score(loaded, t.every).select("email_id", F.struct(*cols).alias("after"))
    return a.join(b, "email_id").select("email_id", (F.col("before") == F.col("after")).alias("same"))


@query
def feature_schema(spark, sf_dir):
    """The ordered feature-name list written as Parquet and read back."""
    import uuid
    from mailsignal.operators import models as H
    from mailsignal.session import scratch_path
    path = scratch_path(spark, "feature_schema", uuid.uuid4().hex)
    H.feature_names(fitted(spark, sf_dir)[1]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# -- streaming (T1-T4): rows-only checks, compared with the batch result in tests ------------

@query
def stream_score(spark, sf_dir):
    from mailsignal.streaming import jobs
    return jobs.stream_score(spark, sf_dir)


@query
def stream_feedback(spark, sf_dir):
    from mailsignal.streaming import jobs
    return jobs.stream_feedback(spark, sf_dir)


@query
def stream_model_scores(spark, sf_dir):
    """T1 with the fitted models: every streamed mail; ``same`` where the sink holds what the batch job gives."""
    import uuid
    from mailsignal.operators import models as H
    from mailsignal.session import scratch_path
    from mailsignal.sources.store import LogStore, fingerprint
    from mailsignal.streaming import jobs
    t = trained(spark, sf_dir)
    version = fingerprint(spark, f"{sf_dir}/documents.parquet")[:12]
    sink = LogStore(spark, scratch_path(spark, "streams", "models", uuid.uuid4().hex))
    cols = ("rf_prediction", "rf_probability_phishing", "svm_prediction", "svm_probability_phishing", "ensemble_label", "ensemble_agreement")
    got = jobs.stream_model_scores(spark, sf_dir, t, version, sink).select("email_id", "model_version", F.struct(*cols).alias("streamed"))
    want = H.score(t, t.every).select("email_id", F.struct(*cols).alias("scored"))
    alike = [F.abs(F.col(f"streamed.{c}") - F.col(f"scored.{c}")) < 1e-9 if "probability" in c else F.col(f"streamed.{c}") == F.col(f"scored.{c}") for c in cols]
    return got.join(want, "email_id").select("email_id", (F.col("model_version") == version).alias("versioned"), F.array_min(F.array(*alike)).alias("same"))


@query
def stream_feedback_state(spark, sf_dir):
    """T2/M1 with keyed state."""
    from mailsignal.streaming import jobs
    return jobs.stream_feedback_state(spark, sf_dir)


@query
def stream_live_accuracy(spark, sf_dir):
    from mailsignal.streaming import jobs
    return jobs.stream_live_accuracy(spark, sf_dir)


@query
def stream_daily_trend(spark, sf_dir):
    from mailsignal.streaming import jobs
    return jobs.stream_daily_trend(spark, sf_dir)


# -- stemming (D5, D7) ---------------------------------------------------------------------------

@query
def porter_stem(spark, sf_dir):
    from mailsignal.operators.stem import stem_tokens
    m = _mails(spark, sf_dir).select("email_id", T.drop_stopwords(T.tokens(T.clean_text("raw_text"))).alias("toks"))
    return stem_tokens(m, "toks", "email_id").select("email_id", F.array_join("lemmas", " ").alias("stems"))


@query
def preprocess_chain(spark, sf_dir):
    from mailsignal.operators.stem import preprocess_chain as chain
    return chain(_mails(spark, sf_dir), "raw_text", "email_id")


# -- files and encodings (A1, A2, A3, A12) ---------------------------------------------------

@query
def csv_corpus_roundtrip(spark, sf_dir):
    """A1/A2: the labelled corpus written as CSV under the shared folder, read back with a schema,
    then preprocessed (D8, B4)."""
    import uuid
    from mailsignal.session import scratch_path
    from mailsignal.sources import files
    path = scratch_path(spark, "corpus_csv", uuid.uuid4().hex)
    files.write_corpus_csv(_corpus(spark, sf_dir).select("email_id", F.col("raw_text").alias("text"), "label"), path)
    back = files.read_corpus_csv(spark, path)
    processed = F.array_join(T.drop_stopwords(T.tokens(T.clean_text("text"))), " ")
    out = back.select("email_id", "label", processed.alias("processed_text"), E.char_count("text").alias("email_length"),
                      E.url_count_range("text").alias("url_count"))
    return out.withColumn("word_count", F.size(T.tokens("processed_text")).cast("bigint")) \
        .filter(F.length("processed_text") > 0)


@query
def json_result_encode(spark, sf_dir):
    """Each mail's result as JSON text, read back into its fields."""
    from mailsignal.sources import files
    s = logs.scored_mails(spark, sf_dir)
    r = s.select("email_id", F.from_json(files.result_json(s), files.RESULT).alias("r")).select("email_id", "r.*")
    one = lambda m: [F.col("individual_predictions")[m][k].alias(f"{m}_{k}") for k in ("prediction", "label", "confidence")] + [
        F.col("individual_predictions")[m]["probabilities"][k].alias(f"{m}_{k}") for k in ("legitimate", "phishing")]
    e, a = F.col("ensemble_prediction"), F.col("email_analysis")
    return r.select("email_id", *one("random_forest"), *one("svm"), *[e[k].alias(f"ensemble_{k}") for k in ("prediction", "label", "confidence", "agreement")],
                    F.array_join(a["suspicious_indicators"], "; ").alias("indicators"), a["risk_score"].alias("risk_score"),
                    *[a["statistics"][k].alias(k) for k in ("character_count", "word_count", "url_count", "suspicious_keyword_count")], "timestamp")


@query
def mail_files(spark, sf_dir):
    """A3: every conversation written as one text file under the shared folder, scanned as uploaded mail files."""
    import uuid
    from mailsignal.session import scratch_path
    from mailsignal.sources import files
    path = scratch_path(spark, "mail_files", uuid.uuid4().hex)
    turns = load(spark, sf_dir, "conversations")
    line = F.concat(F.lpad(F.col("turn").cast("string"), 9, "0"), F.lit(" "), "role", F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " "))
    mails = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))  # one conversation a row
    mails.repartition("conv_id").write.partitionBy("conv_id").text(path)
    got = files.read_mail_files(spark, path)
    return got.select(F.regexp_extract("path", "conv_id=(-?[0-9]+)", 1).cast("bigint").alias("conv_id"), "reject_reason",
                      F.md5(F.rtrim(F.col("text"), F.lit("\n"))).alias("text_md5"))


# -- dimensions (A10, M8, N3) over the event log ----------------------------------------------

def _user_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("category"), F.col("value").alias("weight"),
                    F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 2).alias("half"))


@query
def dimension_newest(spark, sf_dir):
    """M8: one row per user, the newest event's."""
    newest = D.dedup_newest(_user_rows(spark, sf_dir).drop("half"), "key", "at")
    return newest.select("key", "category", "weight", F.col("at.ts").alias("updated_at"))


@query
def dimension_upsert(spark, sf_dir):
    """The newest even events per user as the table, the newest odd ones with a purchase or sign-up as updates of
    its weight; updated rows are touched."""
    rows = _user_rows(spark, sf_dir)
    base = D.dedup_newest(rows.filter("half = 0 and key % 5 <> 0").drop("half"), "key", "at")
    new = D.dedup_newest(rows.filter("half = 1 and category in ('purchase', 'signup')").drop("half"), "key", "at")
    table = base.select("key", "category", "weight", F.col("at.ts").alias("updated_at"))
    return D.upsert(table, new.select("key", "category", "weight"), "key", ["weight"], as_of=TRACKER_AS_OF)
