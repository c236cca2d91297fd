"""DuckDB oracle SQL, one statement per registered query (same column names)."""

from __future__ import annotations

from mailsignal import lexicon as L
from mailsignal.plans.oracle_views import (NWS, q, rcount, with_views)
from mailsignal.plans.oracle_porter import porter_ctes
from mailsignal.sources import views as V

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


MAIL_AS_OF = f"TIMESTAMP '{V.MAIL_AS_OF}'"
TRACKER_AS_OF = f"TIMESTAMP '{V.TRACKER_AS_OF}'"

BAND = "CASE WHEN risk_score > 70 THEN 'danger' WHEN risk_score > 40 THEN 'warning' ELSE 'success' END"

# -- flagship ---------------------------------------------------------------------
oracle("risk_report", with_views(f"""
SELECT {BAND} AS band, count(*)::BIGINT AS mails, round(CAST(avg(risk_score) AS DECIMAL(38,9)), 6)::DOUBLE AS avg_risk,
       count(CASE WHEN url_count > 0 THEN 1 END)::BIGINT AS mails_with_urls, max(risk_score)::BIGINT AS max_risk
FROM scored GROUP BY 1""", "scored"))

oracle("top_risk_mails", with_views(f"""
SELECT email_id, risk_score, {BAND} AS band, array_to_string(suspicious_indicators, '; ') AS indicators
FROM scored ORDER BY risk_score DESC, email_id LIMIT 20""", "scored"))

# -- admission --------------------------------------------------------------------
oracle("admissible_emails", with_views("""
SELECT email_id, length(raw_text)::BIGINT AS n_chars, label FROM adm2 WHERE length(raw_text) <= 10000""", "scored"))

oracle("rejected_emails", with_views(f"""
SELECT email_id, CASE WHEN length(raw_text) = 0 THEN 'empty' ELSE 'too_long' END AS reject_reason
FROM adm WHERE length(raw_text) = 0 OR length(raw_text) > {L.MAX_EMAIL_LENGTH}""", "scored"))

# -- parsing ----------------------------------------------------------------------
oracle("email_headers", with_views("""
SELECT email_id, subject, sender, receiver, date, length(body)::BIGINT AS body_chars, md5(body) AS body_md5
FROM parsed""", "emails"))

oracle("sender_address", with_views("""
SELECT email_id AS email_id, sender_name, sender_email FROM (
  SELECT p.email_id, e.sender_name, e.sender_email FROM parsed p JOIN emails e ON e.id = p.email_id)""", "emails"))

oracle("url_list", with_views("""
SELECT id AS email_id, array_to_string(urls, ' ') AS urls, len(urls)::BIGINT AS n_urls FROM emails""", "emails"))

oracle("url_hosts", with_views("""
SELECT id AS email_id, (u.pos - 1)::BIGINT AS pos, u.url,
       lower(regexp_extract(u.url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host
FROM emails, LATERAL (SELECT unnest(urls) AS url, generate_subscripts(urls, 1) AS pos) u""", "emails"))

oracle("emails_table", with_views("""
SELECT id, sender_email, sender_name, receiver_email, subject, md5(body) AS body_md5,
       md5(processed_text) AS processed_md5, array_to_string(urls, ' ') AS urls, timestamp
FROM emails""", "emails"))

# -- logs -------------------------------------------------------------------------
oracle("prediction_fanout", with_views("""
SELECT id, email_id, model_name, prediction, prediction_label, confidence, probability_legitimate,
       probability_phishing, risk_score, array_to_string(suspicious_indicators, '; ') AS suspicious_indicators,
       timestamp
FROM predictions""", "predictions"))

oracle("activity_log", with_views("SELECT * FROM activity", "activity"))

oracle("tracker_correct_flag", with_views(
    "SELECT id, prediction, actual_label, correct FROM tracker", "tracker"))

# -- scoring ----------------------------------------------------------------------
oracle("model_result", with_views("""
SELECT email_id,
  rf_prediction, CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS rf_label, rf_confidence,
  rf_probability_legitimate, rf_probability_phishing,
  svm_prediction, CASE WHEN svm_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS svm_label, svm_confidence,
  svm_probability_legitimate, svm_probability_phishing
FROM scored""", "scored"))

oracle("ensemble_vote", with_views("""
SELECT email_id, rf_prediction AS ensemble_prediction,
  CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS ensemble_label,
  rf_confidence AS ensemble_confidence, rf_prediction = svm_prediction AS ensemble_agreement
FROM scored""", "scored"))

oracle("risk_score", with_views("""
SELECT email_id, risk_score, url_count, suspicious_keyword_count, character_count, word_count FROM scored""",
                                "scored"))

oracle("risk_indicators", with_views("""
SELECT email_id, array_to_string(suspicious_indicators, '; ') AS indicators,
       len(suspicious_indicators)::BIGINT AS n_indicators FROM scored""", "scored"))

oracle("risk_band", with_views(f"""
SELECT {BAND} AS band, count(*)::BIGINT AS mails FROM scored GROUP BY 1""", "scored"))

oracle("email_hash", with_views("""
SELECT email_id, substr(sha256(raw_text), 1, 10) AS email_hash FROM adm2""", "scored"))

oracle("session_key", with_views("""
SELECT id, md5(strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '|' || ip) AS session_id FROM areq2""", "activity"))

oracle("client_ip", with_views("SELECT id, ip AS client_ip FROM areq2", "activity"))

# -- tracker analytics --------------------------------------------------------------


def _recent(hours: int) -> str:
    return f"timestamp >= {TRACKER_AS_OF} - INTERVAL {hours} HOUR"


oracle("tracker_overall", with_views("""
SELECT count(*)::BIGINT AS total_predictions, count(actual_label)::BIGINT AS labeled_predictions,
       count(CASE WHEN correct = 1 THEN 1 END)::BIGINT AS correct_predictions,
       coalesce(round(CAST(count(CASE WHEN correct = 1 THEN 1 END) AS DOUBLE)
                      / nullif(count(actual_label), 0) * 100, 2), 0.0) AS overall_accuracy
FROM tracker""", "tracker"))

oracle("tracker_recent", with_views(f"""
SELECT count(*)::BIGINT AS recent_total, count(actual_label)::BIGINT AS recent_labeled,
       count(CASE WHEN correct = 1 THEN 1 END)::BIGINT AS recent_correct,
       coalesce(round(CAST(count(CASE WHEN correct = 1 THEN 1 END) AS DOUBLE)
                      / nullif(count(actual_label), 0) * 100, 2), 0.0) AS recent_accuracy
FROM tracker WHERE {_recent(24)}""", "tracker"))

oracle("class_breakdown", with_views(f"""
SELECT CASE WHEN prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS label, count(*)::BIGINT AS count,
       coalesce(round(CAST(avg(confidence) AS DECIMAL(38,9)), 3)::DOUBLE, 0.0) AS avg_confidence
FROM tracker WHERE {_recent(24 * 7)} GROUP BY prediction""", "tracker"))

oracle("confidence_bins", with_views(f"""
SELECT count(CASE WHEN confidence >= 0.9 THEN 1 END)::BIGINT AS high_confidence,
       count(CASE WHEN confidence >= 0.7 AND confidence < 0.9 THEN 1 END)::BIGINT AS medium_confidence,
       count(CASE WHEN confidence < 0.7 THEN 1 END)::BIGINT AS low_confidence
FROM tracker WHERE {_recent(24 * 7)}""", "tracker"))

oracle("accuracy_trend", with_views(f"""
, days AS (
  SELECT CAST(d AS DATE) AS date FROM generate_series(CAST({TRACKER_AS_OF} AS DATE) - INTERVAL 30 DAY,
                                                       CAST({TRACKER_AS_OF} AS DATE), INTERVAL 1 DAY) t(d)
), agg AS (
  SELECT CAST(timestamp AS DATE) AS date, count(*) AS total, sum(correct) AS correct, avg(confidence) AS ac
  FROM tracker WHERE actual_label IS NOT NULL GROUP BY 1
)
SELECT strftime(days.date, '%Y-%m-%d') AS date,
       coalesce(round(CAST(correct AS DOUBLE) / total * 100, 2), 0.0) AS accuracy,
       coalesce(total, 0)::BIGINT AS total_predictions, coalesce(correct, 0)::BIGINT AS correct_predictions,
       coalesce(round(CAST(ac AS DECIMAL(38,9)), 3)::DOUBLE, 0.0) AS avg_confidence
FROM days LEFT JOIN agg ON days.date = agg.date""", "tracker"))

# -- prediction-log analytics --------------------------------------------------------


def _since(days: int) -> str:
    return f"timestamp >= {MAIL_AS_OF} - INTERVAL {days} DAY"


oracle("prediction_statistics", with_views(f"""
SELECT count(*)::BIGINT AS total_predictions,
       count(CASE WHEN prediction = 1 THEN 1 END)::BIGINT AS phishing_detected,
       (count(*) - count(CASE WHEN prediction = 1 THEN 1 END))::BIGINT AS legitimate_emails,
       coalesce(round(CAST(count(CASE WHEN prediction = 1 THEN 1 END) AS DOUBLE) / nullif(count(*), 0) * 100, 2),
                0.0) AS phishing_rate,
       coalesce(round(CAST(avg(confidence) AS DECIMAL(38,9)), 3)::DOUBLE, 0.0) AS average_confidence,
       count(CASE WHEN risk_score > 70 THEN 1 END)::BIGINT AS high_risk_emails
FROM predictions WHERE model_name = 'ensemble' AND {_since(30)}""", "predictions"))

oracle("model_performance", with_views("""
SELECT model_name, count(*)::BIGINT AS total_predictions,
       count(CASE WHEN prediction = 1 THEN 1 END)::BIGINT AS phishing_detected,
       round(CAST(avg(confidence) AS DECIMAL(38,9)), 3)::DOUBLE AS avg_confidence,
       coalesce(round(CAST(count(CASE WHEN prediction = 1 THEN 1 END) AS DOUBLE) / count(*) * 100, 2), 0.0)
         AS phishing_rate
FROM predictions WHERE model_name IN ('random_forest', 'svm', 'ensemble') GROUP BY model_name""", "predictions"))

oracle("model_daily_summary", with_views(f"""
SELECT model_name, CAST(timestamp AS DATE) AS prediction_date, count(*)::BIGINT AS total_predictions,
       count(CASE WHEN prediction = 1 THEN 1 END)::BIGINT AS phishing_detected,
       round(CAST(avg(confidence) AS DECIMAL(38,9)), 6)::DOUBLE AS avg_confidence, round(CAST(avg(risk_score) AS DECIMAL(38,9)), 6)::DOUBLE AS avg_risk_score
FROM predictions WHERE {_since(30)} GROUP BY 1, 2 ORDER BY 2 DESC, 1""", "predictions"))

oracle("daily_statistics", with_views(f"""
SELECT CAST(timestamp AS DATE) AS date, count(*)::BIGINT AS total_emails,
       count(CASE WHEN prediction = 1 THEN 1 END)::BIGINT AS phishing_count,
       count(CASE WHEN prediction = 0 THEN 1 END)::BIGINT AS legitimate_count,
       round(CAST(avg(confidence) AS DECIMAL(38,9)), 3)::DOUBLE AS avg_confidence, round(CAST(avg(risk_score) AS DECIMAL(38,9)), 2)::DOUBLE AS avg_risk_score
FROM predictions WHERE model_name = 'ensemble' AND {_since(90)} GROUP BY 1 ORDER BY 1 DESC""", "predictions"))

oracle("recent_phishing", with_views(f"""
SELECT e.id, e.sender_email, e.subject, p.prediction_label, p.confidence, p.risk_score, p.timestamp
FROM emails e JOIN predictions p ON e.id = p.email_id
WHERE p.model_name = 'ensemble' AND p.prediction = 1 AND p.{_since(30)}
ORDER BY p.timestamp DESC""", "emails", "predictions"))

oracle("recent_predictions", with_views("""
SELECT p.id, strftime(p.timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       CASE WHEN length(coalesce(e.subject, '')) > 50 THEN substr(e.subject, 1, 50) || '...'
            ELSE coalesce(e.subject, '') END AS subject,
       e.sender_email AS sender, p.prediction_label AS prediction, round(p.confidence, 3) AS confidence,
       round(p.risk_score, 1) AS risk_score
FROM predictions p JOIN emails e ON p.email_id = e.id
WHERE p.model_name = 'ensemble' ORDER BY p.timestamp DESC, p.id DESC LIMIT 50""", "emails", "predictions"))

oracle("model_titles", with_views("""
SELECT model_name, CASE model_name WHEN 'random_forest' THEN 'Random Forest' WHEN 'svm' THEN 'Svm'
  WHEN 'ensemble' THEN 'Ensemble' END AS model_title
FROM (SELECT DISTINCT model_name FROM predictions)""", "predictions"))

# -- feedback, retention, referential checks ----------------------------------------
oracle("latest_prediction", with_views("""
SELECT email_hash, created_at, id, prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY created_at DESC, id DESC) AS rn FROM tracker)
WHERE rn = 1""", "tracker"))

_FEEDBACK_APPLY = """
, fb AS (
  SELECT email_hash, actual_label AS fb_label, feedback AS fb_text FROM (
    SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY feedback_at DESC, feedback_id DESC) AS rn
    FROM feedback) WHERE rn = 1
), tgt AS (
  SELECT email_hash, id AS target_id FROM (
    SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY created_at DESC, id DESC) AS rn FROM tracker)
  WHERE rn = 1
), upd AS (
  SELECT target_id, fb_label, fb_text FROM tgt JOIN fb USING (email_hash)
), applied AS (
  SELECT t.id, t.timestamp, t.prediction, t.confidence,
    CAST(CASE WHEN u.target_id IS NOT NULL THEN u.fb_label ELSE t.actual_label END AS INTEGER) AS actual_label,
    CASE WHEN u.target_id IS NOT NULL THEN u.fb_text ELSE t.user_feedback END AS user_feedback,
    t.email_hash, t.created_at
  FROM tracker t LEFT JOIN upd u ON t.id = u.target_id
)
SELECT *, CAST(CASE WHEN actual_label IS NULL THEN NULL WHEN prediction = actual_label THEN 1 ELSE 0 END AS INTEGER)
  AS correct FROM applied"""
oracle("feedback_apply", with_views(_FEEDBACK_APPLY, "tracker", "feedback"))

oracle("feedback_unmatched", with_views("""
SELECT feedback_id, email_hash, actual_label FROM feedback f
WHERE NOT EXISTS (SELECT 1 FROM tracker t WHERE t.email_hash = f.email_hash)""", "tracker", "feedback"))

oracle("feedback_valid", """
WITH req AS (
  SELECT event_id,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE substr(md5(CAST(user_id AS VARCHAR)), 1, 10) END AS email_hash,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN NULL
         WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 1 THEN 'x'
         ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR) END AS actual_label
  FROM events
)
SELECT event_id, email_hash, TRY_CAST(actual_label AS INTEGER) AS actual_label FROM req
WHERE email_hash IS NOT NULL AND email_hash <> '' AND TRY_CAST(actual_label AS INTEGER) IS NOT NULL""")

oracle("orphan_emails", with_views(f"""
SELECT id, timestamp FROM emails e
WHERE {_since(90).replace('>=', '<')}
  AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.email_id = e.id)""", "emails", "predictions"))

oracle("orphan_predictions", with_views("""
SELECT id, email_id, model_name FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM emails e WHERE e.id = p.email_id)""", "emails", "predictions"))

_KEPT = f"""
, kept_preds AS (SELECT * FROM predictions WHERE {_since(90)}),
kept_emails AS (
  SELECT * FROM emails WHERE NOT ({_since(90).replace('>=', '<')}
    AND id NOT IN (SELECT DISTINCT email_id FROM kept_preds WHERE email_id IS NOT NULL))
)"""

oracle("retention_keep", with_views(_KEPT + "\nSELECT id, timestamp FROM kept_emails", "emails", "predictions"))

oracle("retention_counts", with_views(_KEPT + f"""
SELECT 'user_activity' AS table_name, count(*)::BIGINT AS deleted FROM activity
  WHERE {_since(90).replace('>=', '<')}
UNION ALL SELECT 'predictions', (SELECT count(*) FROM predictions) - (SELECT count(*) FROM kept_preds)
UNION ALL SELECT 'emails', (SELECT count(*) FROM emails) - (SELECT count(*) FROM kept_emails)""",
                                      "emails", "predictions", "activity"))

oracle("retention_cascade", with_views(_KEPT + """
SELECT id, email_id, model_name FROM kept_preds WHERE email_id IN (SELECT id FROM kept_emails)""",
                                       "emails", "predictions"))

# -- dictionaries -------------------------------------------------------------------
_KW_VALUES = ", ".join(f"({q(k)}, {q(c)}, {w})" for k, c, w in L.KEYWORD_SEED)
_KW = f"kw AS (SELECT k AS keyword, c AS category, CAST(w AS DOUBLE) AS weight FROM (VALUES {_KW_VALUES}) v(k, c, w))"

oracle("keyword_hits", with_views(f"""
, {_KW}
SELECT r.email_id, kw.keyword, kw.category, kw.weight FROM raw_mails r JOIN kw
  ON contains(lower(r.raw_text), kw.keyword)""", "raw_mails"))

oracle("keyword_category_score", with_views(f"""
, {_KW}
SELECT r.email_id, kw.category, count(*)::BIGINT AS hits, round(sum(kw.weight), 6) AS weighted_score
FROM raw_mails r JOIN kw ON contains(lower(r.raw_text), kw.keyword) GROUP BY 1, 2""", "raw_mails"))

_UP_VALUES = ", ".join(f"({q(p)}, {q(t)}, {w})" for p, t, w in L.URL_PATTERN_SEED)
oracle("url_pattern_hits", with_views(f"""
, up AS (SELECT p AS pattern, t AS pattern_type, CAST(w AS DOUBLE) AS weight FROM (VALUES {_UP_VALUES}) v(p, t, w)),
u AS (SELECT id AS email_id, (x.pos - 1)::BIGINT AS pos, x.url
      FROM emails, LATERAL (SELECT unnest(urls) AS url, generate_subscripts(urls, 1) AS pos) x)
SELECT u.email_id, u.pos, up.pattern_type, count(*)::BIGINT AS hits, round(sum(up.weight), 6) AS weight
FROM u JOIN up ON regexp_matches(u.url, up.pattern) GROUP BY 1, 2, 3""", "emails"))


# -- text ---------------------------------------------------------------------------
from mailsignal.plans.oracle_views import (clean, html_text, kw_count, light, nostop, qlist,  # noqa: E402
                                          substr_count, toks, wcount)

_VT = f"regexp_extract_all({light('raw_text')}, '(\\w\\w+)', 1)"

oracle("clean_text", with_views(f"SELECT email_id, {clean('raw_text')} AS clean_text FROM raw_mails", "raw_mails"))

oracle("html_to_text", f"SELECT page_id, {html_text('html')} AS text FROM pages")

oracle("light_clean", with_views(f"SELECT email_id, {light('raw_text')} AS light_text FROM raw_mails", "raw_mails"))

oracle("tokens", with_views(f"""
SELECT email_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT email_id, {toks(clean('raw_text'))} AS t FROM raw_mails)""", "raw_mails"))

oracle("stopword_filter", with_views(f"""
SELECT email_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT email_id, {nostop(toks(clean('raw_text')))} AS t FROM raw_mails)""", "raw_mails"))

oracle("lemma_lookup", with_views(f"""
, m AS (SELECT email_id, {nostop(toks(clean('raw_text')))} AS toks FROM raw_mails),
vocab AS (SELECT DISTINCT unnest(toks) AS token FROM m),
lem AS (SELECT token, substr(token, 1, length(token) - 1) AS lemma FROM vocab
        WHERE suffix(token, 's') AND NOT suffix(token, 'ss') AND length(token) > 3
          AND substr(token, 1, length(token) - 1) IN (SELECT token FROM vocab)),
x AS (SELECT email_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM m),
y AS (SELECT x.email_id, x.pos, coalesce(lem.lemma, x.token) AS w FROM x LEFT JOIN lem USING (token))
SELECT m.email_id, coalesce(array_to_string(list(y.w ORDER BY y.pos) FILTER (WHERE y.w IS NOT NULL), ' '), '')
  AS lemmas
FROM m LEFT JOIN y USING (email_id) GROUP BY m.email_id""", "raw_mails"))

_STEMS = f"""
, m AS (SELECT email_id, {nostop(toks(clean('raw_text')))} AS toks FROM raw_mails),
seen AS (SELECT DISTINCT unnest(toks) AS t FROM m),
{porter_ctes('seen')},
x AS (SELECT email_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM m),
y AS (SELECT email_id, string_agg(stem, ' ' ORDER BY pos) AS stems FROM x JOIN porter USING (t) GROUP BY email_id)
"""
oracle("porter_stem", with_views(_STEMS + "SELECT email_id, coalesce(stems, '') AS stems FROM m LEFT JOIN y USING (email_id)", "raw_mails"))
oracle("preprocess_chain", with_views(_STEMS + "SELECT email_id, coalesce(stems, '') AS processed_text FROM m LEFT JOIN y USING (email_id)", "raw_mails"))

oracle("accent_fold", "SELECT doc_id, strip_accents(text) AS folded FROM documents")

oracle("word_ngrams", with_views(f"""
, a AS (SELECT email_id, list_filter({_VT}, lambda w: length(w) >= 1
        AND NOT list_contains({qlist(L.STOP_WORDS)}, w)) AS t FROM raw_mails),
b AS (SELECT email_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g
      FROM a)
SELECT email_id, len(g)::BIGINT AS n_terms, array_to_string(g, '|') AS terms FROM b""", "raw_mails"))

oracle("vector_tokens", with_views(f"""
SELECT email_id, len(v)::BIGINT AS n_tokens, array_to_string(v, ' ') AS tokens
FROM (SELECT email_id, {_VT} AS v FROM raw_mails)""", "raw_mails"))

oracle("corpus_preprocess", with_views(f"""
, a AS (SELECT email_id, label, array_to_string({nostop(toks(clean('raw_text')))}, ' ') AS processed_text,
        length(raw_text)::BIGINT AS email_length, {rcount('raw_text', L.URL_PATTERN_RANGE)} AS url_count
        FROM raw_mails)
SELECT email_id, label, processed_text, email_length, url_count,
       len({toks('processed_text')})::BIGINT AS word_count
FROM a WHERE length(processed_text) > 0""", "raw_mails"))

# -- scalar features ------------------------------------------------------------------
_UP = "len(regexp_extract_all(coalesce({x}, ''), '\\p{{Lu}}'))::BIGINT"


def _caps_ratio(x: str) -> str:
    return f"round(CAST({_UP.format(x=x)} AS DOUBLE) / (length(coalesce({x}, '')) + 1), 9)"


_IPB = q(L.IP_PATTERN_BOUNDED)
_IPL = q(L.IP_PATTERN_LOOSE)
_SHORT_TEXT = " OR ".join(f"contains(lower(raw_text), {q(d)})" for d in L.SHORTENERS_5)
_URLS_A = f"regexp_extract_all(raw_text, {q('(' + L.URL_PATTERN_RANGE + ')')}, 1)"
_SHORT_URLS = ("len(list_filter(" + _URLS_A + ", lambda u: "
               + " OR ".join(f"contains(u, {q(d)})" for d in L.SHORTENERS_4) + ")) > 0")
_SENDER = q("|".join(L.SENDER_PATTERNS))

oracle("text_stats", with_views(f"""
SELECT email_id, length(raw_text)::BIGINT AS char_count, {wcount('raw_text')} AS word_count,
       {rcount('raw_text', '[.!?]+')} AS sentence_count FROM raw_mails""", "raw_mails"))

oracle("url_counts", with_views(f"""
SELECT email_id, {rcount('raw_text', L.URL_PATTERN_RANGE)} AS url_count_extract,
       {rcount('raw_text', L.URL_PATTERN_ESCAPED)} AS url_count_escaped,
       {substr_count('raw_text', 'http')} AS url_count_http,
       {rcount('raw_text', 'http[s]?://' + NWS + '+')} AS url_count_nonspace FROM raw_mails""", "raw_mails"))

oracle("punct_counts", with_views(f"""
SELECT email_id, {substr_count('raw_text', '!')} AS exclamation_count, {substr_count('raw_text', '?')} AS question_count,
       {substr_count('raw_text', '$')} AS dollar_count FROM raw_mails""", "raw_mails"))

oracle("caps_features", with_views(f"""
SELECT email_id, {rcount('raw_text', '[A-Z]{3,}')} AS excessive_caps, {_UP.format(x='raw_text')} AS upper_count,
       {_caps_ratio('raw_text')} AS caps_ratio FROM raw_mails""", "raw_mails"))

oracle("ip_flags", with_views(f"""
SELECT email_id, regexp_matches(raw_text, {_IPL}) AS has_ip_address, regexp_matches(raw_text, {_IPB}) AS has_ip_url
FROM raw_mails""", "raw_mails"))

oracle("shortener_flags", with_views(f"""
SELECT email_id, {_SHORT_URLS} AS has_shortened_url, ({_SHORT_TEXT}) AS has_shortened_url_text
FROM raw_mails""", "raw_mails"))

oracle("keyword_counts", with_views(f"""
SELECT email_id, {kw_count('raw_text', L.KEYWORDS_10)} AS suspicious_keyword_count,
       {kw_count('raw_text', L.KEYWORDS_20)} AS configured_keyword_count,
       {kw_count('raw_text', L.KEYWORDS_5)} AS suspicious_keywords FROM raw_mails""", "raw_mails"))

oracle("urgency_counts", with_views(f"""
SELECT email_id, {kw_count('raw_text', L.URGENT_4)} AS urgent_words,
       {kw_count('raw_text', L.URGENCY_10)} AS urgency_indicators FROM raw_mails""", "raw_mails"))

oracle("processed_stats", with_views(f"""
SELECT id, length(processed_text)::BIGINT AS text_length, {wcount('processed_text')} AS word_count FROM emails""",
                                     "emails"))

oracle("subject_features", with_views(f"""
SELECT email_id, length(subject)::BIGINT AS subject_length, {substr_count('subject', '!')} AS subject_exclamation_count,
       {substr_count('subject', '?')} AS subject_question_count, {_caps_ratio('subject')} AS subject_caps_ratio
FROM parsed""", "emails"))

oracle("sender_suspicious", with_views(f"""
SELECT email_id, sender, regexp_matches(lower(sender), {_SENDER}) AS sender_suspicious FROM parsed""", "emails"))

oracle("metadata_features", with_views(f"""
SELECT email_id, length(raw_text)::BIGINT AS email_length, {wcount('raw_text')} AS word_count,
       {substr_count('raw_text', 'http')} AS url_count, {substr_count('raw_text', '!')} AS exclamation_count,
       {substr_count('raw_text', '?')} AS question_count, {substr_count('raw_text', '$')} AS dollar_count,
       {kw_count('raw_text', L.URGENT_4)} AS urgent_words, {kw_count('raw_text', L.KEYWORDS_5)} AS suspicious_keywords
FROM raw_mails""", "raw_mails"))

oracle("metadata_features_full", with_views(f"""
SELECT email_id, length(raw_text)::BIGINT AS text_length, {wcount('raw_text')} AS word_count,
       length(subject)::BIGINT AS subject_length, {substr_count('subject', '!')} AS subject_exclamation_count,
       {substr_count('subject', '?')} AS subject_question_count, {_caps_ratio('subject')} AS subject_caps_ratio,
       {rcount('raw_text', L.URL_PATTERN_ESCAPED)} AS url_count, regexp_matches(raw_text, {_IPB}) AS has_ip_url,
       ({_SHORT_TEXT}) AS has_shortened_url, regexp_matches(lower(sender), {_SENDER}) AS sender_suspicious,
       {kw_count('raw_text', L.KEYWORDS_20)} AS suspicious_keyword_count,
       {kw_count('raw_text', L.URGENCY_10)} AS urgency_indicators,
       {substr_count('raw_text', '!')} AS exclamation_count, {substr_count('raw_text', '?')} AS question_count,
       {_caps_ratio('raw_text')} AS caps_ratio
FROM parsed""", "emails"))

oracle("email_features", with_views(f"""
SELECT email_id, length(raw_text)::BIGINT AS char_count, {wcount('raw_text')} AS word_count,
       {rcount('raw_text', '[.!?]+')} AS sentence_count, len({_URLS_A})::BIGINT AS url_count,
       {_SHORT_URLS} AS has_shortened_url, regexp_matches(raw_text, {_IPL}) AS has_ip_address,
       {rcount('raw_text', '[A-Z]{3,}')} AS excessive_caps, {substr_count('raw_text', '!')} AS exclamation_count,
       {substr_count('raw_text', '?')} AS question_count,
       {kw_count('raw_text', L.KEYWORDS_10)} AS suspicious_keyword_count FROM raw_mails""", "raw_mails"))

oracle("metadata_numeric", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
       coalesce(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 0.0) AS value,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS event_type_num FROM events""")

oracle("json_request_decode", """
SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), 0)::BIGINT AS k,
       coalesce(json_extract_string(props, '$.email_text'), '') AS email_text,
       TRY_CAST(json_extract(props, '$.actual_label') AS INTEGER) AS actual_label FROM events
UNION ALL
SELECT i, CASE WHEN i % 11 = 0 THEN 0 ELSE turn END, CASE WHEN i % 11 = 0 OR i % 7 = 0 THEN '' ELSE coalesce(text, '') END,
       CASE WHEN i % 11 <> 0 AND i % 3 <> 0 THEN (i % 2)::INTEGER END
FROM (SELECT conv_id * 1000 + turn AS i, turn, text FROM conversations)""")

oracle("percent_text", with_views("""
SELECT email_id, printf('%.1f%%', rf_confidence * 100) AS confidence_text FROM scored""", "scored"))

# -- vectorisation --------------------------------------------------------------------
_STOP = qlist(L.STOP_WORDS)
_TFIDF_BASE = f"""
, t1 AS (SELECT email_id, list_filter({_VT}, lambda w: length(w) >= 1 AND NOT list_contains({_STOP}, w)) AS t
         FROM raw_mails),
terms AS (SELECT email_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
          FROM t1),
tc AS (SELECT email_id, term, count(*) AS tf FROM (SELECT email_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY 1),
nd AS (SELECT count(*) AS n FROM raw_mails),
vocab0 AS (SELECT term, df, total FROM st, nd WHERE df >= {L.MIN_DF} AND df <= floor({L.MAX_DF} * n)
           ORDER BY total DESC, term LIMIT {L.MAX_FEATURES}),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS idx, df::BIGINT AS df,
                 total::BIGINT AS total, n AS n_docs FROM vocab0, nd),
w0 AS (SELECT tc.email_id, tc.term, v.idx,
              (1 + ln(tc.tf)) * (ln(CAST(v.n_docs + 1 AS DOUBLE) / CAST(v.df + 1 AS DOUBLE)) + 1) AS w
       FROM tc JOIN vocab v USING (term)),
weights AS (SELECT email_id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY email_id)), 9) AS weight FROM w0)
"""

oracle("tfidf_vocabulary", with_views(_TFIDF_BASE + "SELECT term, idx, df, total FROM vocab", "raw_mails"))
oracle("tfidf_weights", with_views(_TFIDF_BASE + "SELECT email_id, term, idx, weight FROM weights", "raw_mails"))

oracle("tfidf_transform", with_views(_TFIDF_BASE + f"""
, c1 AS (SELECT conv_id * 1000 + turn AS msg_id,
         list_filter(regexp_extract_all({light('text')}, '(\\w\\w+)', 1),
                     lambda w: length(w) >= 1 AND NOT list_contains({_STOP}, w)) AS t FROM conversations),
c2 AS (SELECT msg_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
       FROM c1),
ctc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(terms) AS term FROM c2) GROUP BY 1, 2),
cw AS (SELECT ctc.msg_id, ctc.term, v.idx,
              (1 + ln(ctc.tf)) * (ln(CAST(v.n_docs + 1 AS DOUBLE) / CAST(v.df + 1 AS DOUBLE)) + 1) AS w
       FROM ctc JOIN vocab v USING (term))
SELECT msg_id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 9) AS weight FROM cw""",
                                     "raw_mails"))

oracle("chi2_select", with_views(_TFIDF_BASE + """
, obs AS (SELECT term, label, sum(weight) AS o FROM weights JOIN raw_mails USING (email_id) GROUP BY 1, 2),
prior AS (SELECT label, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM raw_mails) AS p FROM raw_mails GROUP BY 1),
cells AS (SELECT t.term, pr.p, coalesce(o.o, 0.0) AS o
          FROM (SELECT DISTINCT term FROM obs) t CROSS JOIN prior pr
          LEFT JOIN obs o ON o.term = t.term AND o.label = pr.label),
tot AS (SELECT term, sum(o) AS total FROM obs GROUP BY 1),
chi AS (SELECT term, round(sum((o - p * total) * (o - p * total) / (p * total)), 6) AS chi2
        FROM cells JOIN tot USING (term) GROUP BY term)
SELECT term, chi2 FROM chi ORDER BY chi2 DESC, term LIMIT 1000""", "raw_mails"))

_META = f"""
, meta AS (
SELECT email_id, length(raw_text)::BIGINT AS email_length, {wcount('raw_text')} AS word_count,
       {substr_count('raw_text', 'http')} AS url_count, {substr_count('raw_text', '!')} AS exclamation_count,
       {substr_count('raw_text', '?')} AS question_count, {substr_count('raw_text', '$')} AS dollar_count,
       {kw_count('raw_text', L.URGENT_4)} AS urgent_words, {kw_count('raw_text', L.KEYWORDS_5)} AS suspicious_keywords
FROM raw_mails)"""
_META_COLS = ["email_length", "word_count", "url_count", "exclamation_count", "question_count", "dollar_count",
              "urgent_words", "suspicious_keywords"]
oracle("standard_scale", with_views(_META + "\nSELECT email_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END, 9) AS {c}" for c in _META_COLS) + " FROM meta", "raw_mails"))

# -- splitting --------------------------------------------------------------------------
_H = "md5('42|' || CAST({id} AS VARCHAR))"

oracle("stratified_split", f"""
SELECT doc_id, label, CASE WHEN rn < round(n_class * {L.TEST_SIZE}) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, toxic AS label,
         row_number() OVER (PARTITION BY toxic ORDER BY {_H.format(id='doc_id')}, doc_id) - 1 AS rn,
         count(*) OVER (PARTITION BY toxic) AS n_class
  FROM labels)""")

_TRAIN_VOCAB = f"""
, sp AS (SELECT email_id, CASE WHEN rn < round(n_class * {L.TEST_SIZE}) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT email_id, row_number() OVER (PARTITION BY label ORDER BY {_H.format(id='email_id')}, email_id) - 1 AS rn,
         count(*) OVER (PARTITION BY label) AS n_class FROM raw_mails)),
t1 AS (SELECT email_id, list_filter({_VT}, lambda w: length(w) >= 1 AND NOT list_contains({_STOP}, w)) AS t
         FROM raw_mails),
terms AS (SELECT email_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
          FROM t1),
tc AS (SELECT email_id, term, count(*) AS tf FROM (SELECT email_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tc JOIN sp USING (email_id) WHERE split = 'train' GROUP BY 1),
nd AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
vocab0 AS (SELECT term, df, total FROM st, nd WHERE df >= {L.MIN_DF} AND df <= floor({L.MAX_DF} * n)
           ORDER BY total DESC, term LIMIT {L.MAX_FEATURES}),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS idx, df, n AS n_docs FROM vocab0, nd),
"""
oracle("split_then_fit", with_views(_TRAIN_VOCAB + """w0 AS (SELECT tc.email_id, tc.term, v.idx,
              (1 + ln(tc.tf)) * (ln(CAST(v.n_docs + 1 AS DOUBLE) / CAST(v.df + 1 AS DOUBLE)) + 1) AS w
       FROM tc JOIN vocab v USING (term) JOIN sp USING (email_id) WHERE sp.split = 'test')
SELECT email_id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY email_id)), 9) AS weight FROM w0""",
                                    "raw_mails"))

oracle("stratified_folds", with_views(f"""
SELECT email_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_H.format(id='email_id')}, email_id) - 1)
  % 5 AS INTEGER) AS fold FROM raw_mails""", "raw_mails"))

oracle("shuffle_index", f"""
SELECT doc_id, (row_number() OVER (ORDER BY {_H.format(id='doc_id')}, doc_id) - 1)::BIGINT AS shuffle_index
FROM documents""")

oracle("class_weights", """
SELECT doc_id, toxic AS label,
       CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY toxic)) AS class_weight
FROM labels""")

oracle("corpus_summary", with_views(f"""
SELECT count(*)::BIGINT AS total, count(CASE WHEN label = 1 THEN 1 END)::BIGINT AS phishing,
       count(CASE WHEN label = 0 THEN 1 END)::BIGINT AS legitimate, round(CAST(avg(length(raw_text)) AS DECIMAL(38,9)), 6)::DOUBLE AS avg_length,
       round(CAST(avg({wcount('raw_text')}) AS DECIMAL(38,9)), 6)::DOUBLE AS avg_words,
       count(CASE WHEN {substr_count('raw_text', 'http')} > 0 THEN 1 END)::BIGINT AS with_urls,
       round(CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) / count(*) * 100, 2) AS phishing_pct
FROM raw_mails""", "raw_mails"))

# -- evaluation -----------------------------------------------------------------------------
_EV = """
, ev AS (
  SELECT email_id, label, raw_text, 'random_forest' AS model_name, rf_prediction AS prediction,
         rf_probability_phishing AS score FROM scored
  UNION ALL SELECT email_id, label, raw_text, 'svm', svm_prediction, svm_probability_phishing FROM scored
  UNION ALL SELECT email_id, label, raw_text, 'ensemble', rf_prediction, rf_probability_phishing FROM scored
), cm AS (
  SELECT model_name, count(CASE WHEN label = 0 AND prediction = 0 THEN 1 END)::BIGINT AS tn,
         count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END)::BIGINT AS fp,
         count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END)::BIGINT AS fn,
         count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END)::BIGINT AS tp
  FROM ev GROUP BY model_name
), bm AS (
  SELECT model_name, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM cm
), bm2 AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM bm
), rk AS (
  SELECT model_name, label, rank() OVER (PARTITION BY model_name ORDER BY score)
         + (count(*) OVER (PARTITION BY model_name, score) - 1) / 2.0 AS r FROM ev
), auc AS (
  SELECT model_name, (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - count(CASE WHEN label = 1 THEN 1 END)
         * (count(CASE WHEN label = 1 THEN 1 END) + 1) / 2.0)
         / (count(CASE WHEN label = 1 THEN 1 END) * count(CASE WHEN label = 0 THEN 1 END)) AS roc_auc
  FROM rk GROUP BY model_name
), comp AS (
  SELECT model_name, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall,
         round(f1_score, 4) AS f1_score, round(roc_auc, 4) AS roc_auc FROM bm2 JOIN auc USING (model_name)
)"""

oracle("binary_metrics", with_views(_EV + """
SELECT model_name, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1_score, 9) AS f1_score FROM bm2""", "scored"))
oracle("roc_auc", with_views(_EV + "\nSELECT model_name, round(roc_auc, 9) AS roc_auc FROM auc", "scored"))
oracle("confusion_matrix", with_views(_EV + "\nSELECT * FROM cm", "scored"))
oracle("model_comparison", with_views(_EV + "\nSELECT * FROM comp", "scored"))

oracle("classification_report", with_views(_EV + """
, pc AS (
  SELECT model_name, '1' AS row, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, tp + fn AS support, tp + tn + fp + fn AS n
  FROM cm
  UNION ALL
  SELECT model_name, '0', coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0),
         coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0), tn + fp, tp + tn + fp + fn FROM cm
), pc2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM pc)
SELECT model_name, row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support::BIGINT AS support FROM pc2
UNION ALL
SELECT model_name, 'accuracy', NULL, NULL, round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0), 6),
       (tp + tn + fp + fn)::BIGINT FROM cm
UNION ALL
SELECT model_name, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       max(n)::BIGINT FROM pc2 GROUP BY model_name
UNION ALL
SELECT model_name, 'weighted avg', round(sum(precision * support) / max(n), 6), round(sum(recall * support) / max(n), 6),
       round(sum(f1_score * support) / max(n), 6), max(n)::BIGINT FROM pc2 GROUP BY model_name""", "scored"))

oracle("best_model_by_metric", with_views(_EV + """
, lng AS (
  SELECT model_name, CASE model_name WHEN 'random_forest' THEN 1 WHEN 'svm' THEN 2 ELSE 3 END AS o,
         unnest(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc']) AS metric,
         unnest([accuracy, precision, recall, f1_score, roc_auc]) AS value FROM comp
)
SELECT metric, model_name AS best_model, CAST(value AS DOUBLE) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, o) AS rn FROM lng) WHERE rn = 1""",
                                          "scored"))

oracle("metric_history", with_views(_EV + f"""
SELECT model_name, unnest(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc']) AS metric_name,
       CAST(unnest([accuracy, precision, recall, f1_score, roc_auc]) AS DOUBLE) AS metric_value,
       {MAIL_AS_OF} AS evaluation_date, CAST((SELECT count(*) FROM scored) AS INTEGER) AS dataset_size,
       'hold-out evaluation' AS notes FROM comp""", "scored"))

oracle("prediction_outcomes", with_views(_EV + """
SELECT email_id, label AS actual, coalesce(prediction, 0) AS predicted, coalesce(prediction, 0) = label AS correct,
       substr(raw_text, 1, 60) || '...' AS preview FROM ev WHERE model_name = 'ensemble'""", "scored"))

# -- files ----------------------------------------------------------------------------------
oracle("mail_files", """
SELECT conv_id, NULL::VARCHAR AS reject_reason, md5(string_agg(line, chr(10) ORDER BY line)) AS text_md5
FROM (SELECT conv_id, lpad(turn::VARCHAR, 9, '0') || ' ' || role || ': ' || regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') AS line
      FROM conversations) GROUP BY conv_id""")

# -- trained features (vocabulary of the training split) ---------------------------------------
_SCHEMA = _TRAIN_VOCAB.rstrip().rstrip(",") + """
, schema_rows AS (SELECT idx, term AS name FROM vocab
  UNION ALL SELECT (SELECT count(*) FROM vocab) + i, n FROM (VALUES """ + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_META_COLS)) + """) x(i, n))
"""
oracle("feature_schema", with_views(_SCHEMA + "SELECT idx::BIGINT AS idx, name FROM schema_rows", "raw_mails"))
oracle("feature_counts", with_views(_SCHEMA + """
SELECT (SELECT count(*) FROM vocab) AS tfidf_features, 8::BIGINT AS metadata_features, count(*) AS total_features FROM schema_rows""", "raw_mails"))
oracle("feature_assembly", with_views(_SCHEMA + _META + """
, fw AS (SELECT tc.email_id, v.idx, (1 + ln(tc.tf)) * (ln(CAST(v.n_docs + 1 AS DOUBLE) / CAST(v.df + 1 AS DOUBLE)) + 1) AS w
  FROM tc JOIN vocab v USING (term))
SELECT email_id, idx::BIGINT AS idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY email_id)), 9) AS value FROM fw
""" + "".join(f"UNION ALL SELECT email_id, (SELECT count(*) FROM vocab) + {i}, CAST({c} AS DOUBLE) FROM meta\n" for i, c in enumerate(_META_COLS)), "raw_mails"))
oracle("feature_align", with_views(_SCHEMA + f"""
, c1 AS (SELECT conv_id * 1000 + turn AS msg_id, list_filter(regexp_extract_all({light('text')}, '(\\w\\w+)', 1),
                     lambda w: length(w) >= 1 AND NOT list_contains({_STOP}, w)) AS t FROM conversations),
c2 AS (SELECT msg_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM c1),
ctc AS (SELECT msg_id, term, count(*) AS tf FROM (SELECT msg_id, unnest(terms) AS term FROM c2) GROUP BY 1, 2),
cst AS (SELECT term, count(*) AS df, sum(tf) AS total FROM ctc GROUP BY 1),
cn AS (SELECT count(*) AS n FROM conversations),
cv AS (SELECT term, df, n FROM cst, cn WHERE df >= {L.MIN_DF} AND df <= floor({L.MAX_DF} * n) ORDER BY total DESC, term LIMIT {L.MAX_FEATURES}),
cw AS (SELECT msg_id, term, (1 + ln(tf)) * (ln(CAST(n + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1) AS w FROM ctc JOIN cv USING (term)),
cx AS (SELECT msg_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 9) AS value FROM cw)
SELECT msg_id, idx::BIGINT AS idx, value FROM cx JOIN schema_rows ON name = term""", "raw_mails"))
# Trained models: which rows there must be, and that each agrees with the models' own tables
_PART = f"""
, part AS (SELECT email_id, label, CASE WHEN rn < round(n_class * {L.TEST_SIZE}) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format(id='email_id')}, email_id) - 1 AS rn,
         count(*) OVER (PARTITION BY label) AS n_class FROM raw_mails))
"""
for _k in ("rf_fit_predict", "svm_fit_predict", "svm_calibrated"):
    oracle(_k, with_views(_PART + "SELECT email_id, label, TRUE AS same FROM part WHERE split = 'test'", "raw_mails"))
oracle("svm_rff", with_views(_PART + "SELECT email_id, label, split, TRUE AS same FROM part", "raw_mails"))
oracle("score_emails", with_views("""SELECT email_id, label, risk_score, array_to_string(suspicious_indicators, '; ') AS indicators, TRUE AS same FROM scored""", "scored"))
oracle("training_job", with_views(_PART + """SELECT m AS model_name, count(*) AS test_mails, TRUE AS in_bounds, TRUE AS above_majority
FROM part, (VALUES ('random_forest'), ('svm'), ('ensemble')) x(m) WHERE split = 'test' GROUP BY m""", "raw_mails"))
oracle("cv_summary", with_views(_PART + """SELECT m AS model_name, count(*) AS mails, 5::BIGINT AS folds, TRUE AS in_bounds, TRUE AS adds_up, TRUE AS above_majority
FROM part, (VALUES ('random_forest'), ('svm')) x(m) WHERE split = 'train' GROUP BY m""", "raw_mails"))
oracle("feature_importance", with_views(_SCHEMA + "SELECT idx::BIGINT AS idx, name, TRUE AS same FROM schema_rows", "raw_mails"))
oracle("grid_search", """
WITH forest AS (SELECT * FROM (VALUES (50), (100), (200)) a(num_trees), (VALUES (10), (20), (NULL)) b(max_depth), (VALUES (2), (5), (10)) c(min_split),
                (VALUES (1), (2), (4)) d(min_instances), (VALUES ('sqrt'), ('log2')) e(max_features)),
svm AS (SELECT * FROM (VALUES (0.1), (1.0), (10.0)) a(c), (VALUES ('rbf', 'scale'), ('rbf', 'auto'), ('rbf', '0.01'), ('rbf', '0.1'), ('linear', NULL)) b(kernel, gamma))
SELECT 'random_forest' AS model_name, num_trees, max_depth, min_split, min_instances, max_features, NULL::VARCHAR AS kernel, NULL::DOUBLE AS c, NULL::VARCHAR AS gamma,
       TRUE AS in_bounds, TRUE AS finds FROM forest
UNION ALL SELECT 'svm', NULL, NULL, NULL, NULL, NULL, kernel, c::DOUBLE, gamma, TRUE, TRUE FROM svm""")
oracle("json_result_encode", with_views("SELECT email_id, " + ", ".join(f"{p}_{k} AS {m}_{k}" for m, p in (("random_forest", "rf"), ("svm", "svm")) for k in ("prediction", "label", "confidence"))
       .replace("rf_label AS", "CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS").replace("svm_label AS", "CASE WHEN svm_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS") + """,
  rf_probability_legitimate AS random_forest_legitimate, rf_probability_phishing AS random_forest_phishing, svm_probability_legitimate AS svm_legitimate, svm_probability_phishing AS svm_phishing,
  rf_prediction AS ensemble_prediction, CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS ensemble_label, rf_confidence AS ensemble_confidence,
  rf_prediction = svm_prediction AS ensemble_agreement, array_to_string(suspicious_indicators, '; ') AS indicators, risk_score, character_count, word_count, url_count,
  suspicious_keyword_count, strftime(predicted_at, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM scored""", "scored"))
oracle("model_roundtrip", "SELECT doc_id AS email_id, TRUE AS same FROM documents")

# -- dimensions -------------------------------------------------------------------------------
_NEWEST = """
SELECT user_id AS key, event_type AS category, value AS weight, ts AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE {cond}) WHERE rn = 1"""
oracle("dimension_newest", _NEWEST.format(cond="true"))
oracle("dimension_upsert", f"""
WITH b AS ({_NEWEST.format(cond="event_id % 2 = 0 AND user_id % 5 <> 0")}),
n AS ({_NEWEST.format(cond="event_id % 2 = 1 AND event_type IN ('purchase', 'signup')")})
SELECT coalesce(b.key, n.key) AS key, coalesce(b.category, n.category) AS category, coalesce(n.weight, b.weight) AS weight,
       CASE WHEN n.key IS NOT NULL THEN {TRACKER_AS_OF} ELSE b.updated_at END AS updated_at
FROM b FULL JOIN n ON b.key = n.key""")

# -- streams (the state after all input) ------------------------------------------------------
oracle("stream_score", with_views(f"""
SELECT email_id, received_at, risk_score, {BAND} AS band, suspicious_indicators, rf_prediction AS ensemble_prediction,
       CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS ensemble_label, rf_confidence AS ensemble_confidence,
       rf_prediction = svm_prediction AS ensemble_agreement, substr(sha256(raw_text), 1, 10) AS email_hash
FROM scored""", "scored"))
oracle("stream_feedback", with_views(_FEEDBACK_APPLY, "tracker", "feedback"))
oracle("stream_live_accuracy", with_views("""
, w AS (SELECT unnest(generate_series(date_trunc('hour', timestamp) - INTERVAL 23 HOUR, date_trunc('hour', timestamp), INTERVAL 1 HOUR)) AS window_start,
               actual_label, correct FROM tracker)
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*)::BIGINT AS total, count(actual_label)::BIGINT AS labeled,
       count(CASE WHEN correct = 1 THEN 1 END)::BIGINT AS correct,
       coalesce(round(count(CASE WHEN correct = 1 THEN 1 END)::DOUBLE / nullif(count(actual_label), 0) * 100, 2), 0.0) AS accuracy
FROM w GROUP BY window_start""", "tracker"))
oracle("stream_daily_trend", with_views("""
SELECT CAST(timestamp AS DATE) AS date, count(*)::BIGINT AS total_predictions, sum(correct)::BIGINT AS correct_predictions,
       round(CAST(avg(confidence) AS DECIMAL(38,9)), 3)::DOUBLE AS avg_confidence,
       round(sum(correct)::DOUBLE / count(*) * 100, 2) AS accuracy
FROM tracker WHERE actual_label IS NOT NULL GROUP BY 1""", "tracker"))
oracle("csv_corpus_roundtrip", ORACLE["corpus_preprocess"])

# -- rollups: the reports on the whole log, after feedback where labels count ------------------------
_AFTER = _FEEDBACK_APPLY[:_FEEDBACK_APPLY.index("\nSELECT *, CAST(CASE")] + """
, after AS (SELECT *, CASE WHEN actual_label IS NULL THEN NULL WHEN prediction = actual_label THEN 1 ELSE 0 END AS correct FROM applied)
"""
for _old, _new in (("tracker_overall", "rollup_overall"), ("accuracy_trend", "rollup_accuracy_trend"), ("class_breakdown", "rollup_class_breakdown"), ("confidence_bins", "rollup_confidence_bins")):
    _body = ORACLE[_old][len(with_views("", "tracker")):]
    oracle(_new, with_views("", "tracker", "feedback") + _AFTER + _body.replace("FROM tracker", "FROM after"))
oracle("rollup_recent", with_views("", "tracker", "feedback") + _AFTER + """SELECT count(*)::BIGINT AS recent_total, count(actual_label)::BIGINT AS recent_labeled,
  count(CASE WHEN correct = 1 THEN 1 END)::BIGINT AS recent_correct,
  coalesce(round(CAST(count(CASE WHEN correct = 1 THEN 1 END) AS DOUBLE) / nullif(count(actual_label), 0) * 100, 2), 0.0) AS recent_accuracy
FROM after WHERE timestamp >= TIMESTAMP '2024-01-20 12:34:56' - INTERVAL 24 HOUR""")
oracle("rollup_model_daily", ORACLE["model_daily_summary"])
oracle("rollup_daily_statistics", ORACLE["daily_statistics"])

# -- streams with fitted models and keyed state ------------------------------------------------------
oracle("stream_model_scores", "SELECT doc_id AS email_id, TRUE AS versioned, TRUE AS same FROM documents")
oracle("stream_feedback_state", ORACLE["feedback_apply"])

# -- dictionaries of the corpus's size ---------------------------------------------------------------
_DICTIONARY = with_views("""
, told AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS keyword FROM conversations),
read AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS keyword FROM documents),
kw AS (SELECT keyword, substr(keyword, 1, 1) AS category, length(keyword) / 4 AS weight FROM read WHERE length(keyword) >= 9 AND keyword NOT IN (SELECT keyword FROM told))
SELECT r.email_id, kw.category, count(*)::BIGINT AS hits, round(sum(kw.weight), 6) AS weighted_score
FROM raw_mails r JOIN kw ON contains(lower(r.raw_text), kw.keyword) GROUP BY 1, 2""", "raw_mails")
oracle("dictionary_hits", _DICTIONARY)
oracle("dictionary_hits_joined", _DICTIONARY)
