"""The derived views written as DuckDB SQL (independently of the Spark code).

Each view is a CTE over the driver's pre-registered tables; ``with_views``
prefixes a query with the CTEs it names, in dependency order.
"""

from __future__ import annotations

from html.entities import html5

from mailsignal import lexicon as L
from mailsignal.sources import views as V

# leading "name: value" lines with their folded continuations, as RE2 reads them
HEADER_LINES = r"^((?:[!-9;-~]+:[^\n]*(?:\n[ \t][^\n]*)*(?:\n|$))*)"
WS = r"[ \t\n\x0B\f\r]"
NWS = r"[^ \t\n\x0B\f\r]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def kw_found(x: str, words) -> str:
    """List of the words found (list order) in lower(x)."""
    cases = ", ".join(f"CASE WHEN contains(lower({x}), {q(w)}) THEN {q(w)} END" for w in words)
    return f"list_filter([{cases}], lambda k: k IS NOT NULL)"


def kw_count(x: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({x}), {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")::BIGINT"


def rcount(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {q(pattern)}))::BIGINT"


def substr_count(x: str, needle: str) -> str:
    return f"((length(coalesce({x}, '')) - length(replace(coalesce({x}, ''), {q(needle)}, ''))) // {len(needle)})::BIGINT"


def wcount(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), {q(WS + '+')}), lambda w: w <> ''))::BIGINT"


#: What looks like a character reference. A decimal one that runs into letters a-f is none and stays.
REFERENCE = r"&(?:#[xX][0-9a-fA-F]+|#[0-9][0-9a-fA-F]*|[a-zA-Z][a-zA-Z0-9]*);?"
#: Python's own table of HTML5 names, with and without semicolon, as a SQL map.
_NAMES = sorted({n.rstrip(";"): c for n, c in html5.items()}.items())
NAMES = f"MAP({qlist(n for n, _ in _NAMES)}, {qlist(c for _, c in _NAMES)})"
#: The characters that numbers 128 to 159 stand for (Windows-1252); five of them are themselves.
LOW_CONTROLS = qlist(bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(128, 160))


def references(x: str) -> str:
    """Every character reference of ``x`` in one pass: the text is split at them and joined with what they stand for."""
    body = "replace(replace(r, '&', ''), ';', '')"
    number = f"CASE WHEN lower(r)[3:3] = 'x' THEN try_cast('0x' || {body}[3:] AS BIGINT) ELSE try_cast({body}[2:] AS BIGINT) END"
    char = (f"list_transform([{number}], lambda n: CASE WHEN n BETWEEN 128 AND 159 THEN ({LOW_CONTROLS})[(n - 127)::BIGINT] "
            "WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN chr(n::INTEGER) ELSE chr(65533) END)[1]")
    one = (f"CASE WHEN regexp_matches(r, '^&#[0-9]+[a-fA-F]') THEN r WHEN r[2:2] = '#' THEN {char} ELSE coalesce({NAMES}[{body}], r) END")
    return (f"list_transform([{x}], lambda t: CASE WHEN contains(t, '&') THEN array_to_string(list_transform(list_zip(string_split_regex(t, {q(REFERENCE)}), "
            f"list_transform(regexp_extract_all(t, {q(REFERENCE)}), lambda r: {one})), lambda z: z[1] || coalesce(z[2], '')), '') ELSE t END)[1]")


def html_text(x: str) -> str:
    t = f"regexp_replace({x}, {q(r'(?s)<!--.*?-->')}, '', 'g')"
    t = f"regexp_replace({t}, {q(r'(?is)<(script|style)\b[^>]*>.*?</(script|style)[ \t\n\f\r]*>')}, '', 'g')"
    t = f"regexp_replace({t}, {q(r'<[a-zA-Z/!?][^>]*>')}, '', 'g')"
    return references(t)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def clean(x: str) -> str:
    t = html_text(f"lower(coalesce({x}, ''))")
    t = f"regexp_replace({t}, {q('http[s]?://' + NWS + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(NWS + '+@' + NWS + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'[^a-zA-Z \t\n\x0B\f\r]')}, ' ', 'g')"
    return squeeze(t)


def light(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), {q(r'[^a-zA-Z0-9 \t\n\x0B\f\r]')}, ' ', 'g')"
    return squeeze(t)


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def nostop(x: str) -> str:
    return f"list_filter({x}, lambda w: length(w) >= 3 AND NOT list_contains({qlist(L.STOP_WORDS)}, w))"


def header(block: str, name: str) -> str:
    value = f"regexp_extract({block}, {q('(?im)^' + name + r':[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)')}, 1)"
    return f"regexp_replace({value}, {q(r'\n[ \t]+')}, ' ', 'g')"


def addr_name(x: str) -> str:
    n = f"trim(regexp_extract(coalesce({x}, ''), {q(r'^([^<]*)<[^<>]*>')}, 1))"
    n = f"regexp_replace({n}, {q('^\"(.*)\"$')}, '\\1')"
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), {q('<[^<>]*>')}) THEN {n} ELSE '' END"


def addr_email(x: str) -> str:
    return (f"CASE WHEN regexp_matches(coalesce({x}, ''), {q('<[^<>]*>')}) "
            f"THEN trim(regexp_extract({x}, {q('<([^<>]*)>')}, 1)) ELSE trim(coalesce({x}, '')) END")


RAW_MAILS = f"""
raw_mails AS (
  SELECT doc_id AS email_id,
    'From: ' || ({qlist(V.SENDERS)})[doc_id % 7 + 1] || chr(10)
      || 'To: ' || ({qlist(V.RECEIVERS)})[doc_id % 3 + 1] || chr(10)
      || 'Subject: ' || ({qlist(V.SUBJECTS)})[doc_id % 10 + 1] || chr(10) || chr(10)
      || coalesce(text, '') || chr(10) || ({qlist(V.CLOSINGS)})[doc_id % 10 + 1] AS raw_text,
    CAST(CASE WHEN doc_id % 37 = 0 THEN 1 - (CASE WHEN doc_id % 10 < 5 THEN 1 ELSE 0 END)
              ELSE (CASE WHEN doc_id % 10 < 5 THEN 1 ELSE 0 END) END AS INTEGER) AS label,
    TIMESTAMP '{V.MAIL_EPOCH}' + INTERVAL 1 DAY * (doc_id % 120) + INTERVAL 1 HOUR * (doc_id % 24) AS received_at
  FROM documents
)"""

SCORED = f"""
adm AS (
  SELECT email_id, {strip('raw_text')} AS raw_text, label, received_at FROM raw_mails
),
adm2 AS (
  SELECT * FROM adm WHERE length(raw_text) > 0
),
an AS (
  SELECT *, {rcount('raw_text', 'http[s]?://' + NWS + '+')} AS url_count,
         {kw_found('raw_text', L.KEYWORDS_20)} AS found_keywords,
         CAST((email_id * 37) % 1000 AS DOUBLE) / 1000 AS p_rf,
         CAST((email_id * 53) % 1000 AS DOUBLE) / 1000 AS p_svm
  FROM adm2
),
scored AS (
  SELECT email_id, raw_text, label, received_at, url_count, found_keywords,
    len(found_keywords)::BIGINT AS suspicious_keyword_count,
    least(100, url_count * 10 + len(found_keywords) * 8)::BIGINT AS risk_score,
    list_filter([CASE WHEN url_count > 0 THEN 'Contains ' || CAST(url_count AS VARCHAR) || ' URL(s)' END,
                 CASE WHEN len(found_keywords) > 0 THEN 'Suspicious keywords: '
                      || array_to_string(list_slice(found_keywords, 1, 5), ', ') END], lambda z: z IS NOT NULL)
      AS suspicious_indicators,
    length(raw_text)::BIGINT AS character_count,
    {wcount('raw_text')} AS word_count,
    CASE WHEN p_rf > 0.5 THEN 1 ELSE 0 END AS rf_prediction,
    CASE WHEN p_rf > 0.5 THEN p_rf ELSE 1.0 - p_rf END AS rf_confidence,
    1.0 - p_rf AS rf_probability_legitimate, p_rf AS rf_probability_phishing,
    CASE WHEN p_svm > 0.5 THEN 1 ELSE 0 END AS svm_prediction,
    CASE WHEN p_svm > 0.5 THEN p_svm ELSE 1.0 - p_svm END AS svm_confidence,
    1.0 - p_svm AS svm_probability_legitimate, p_svm AS svm_probability_phishing,
    received_at + INTERVAL 1 HOUR AS predicted_at
  FROM an
)"""

PREDICTIONS = """
fan AS (
  SELECT email_id * 3 AS id, email_id, 'random_forest' AS model_name, rf_prediction AS prediction,
         CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS prediction_label,
         rf_confidence AS confidence, rf_probability_legitimate AS probability_legitimate,
         rf_probability_phishing AS probability_phishing, CAST(risk_score AS DOUBLE) AS risk_score,
         suspicious_indicators, predicted_at AS timestamp FROM scored
  UNION ALL
  SELECT email_id * 3 + 1, email_id, 'svm', svm_prediction,
         CASE WHEN svm_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END,
         svm_confidence, svm_probability_legitimate, svm_probability_phishing, CAST(risk_score AS DOUBLE),
         suspicious_indicators, predicted_at FROM scored
  UNION ALL
  SELECT email_id * 3 + 2, email_id, 'ensemble', rf_prediction,
         CASE WHEN rf_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END,
         rf_confidence, 0.0, 0.0, CAST(risk_score AS DOUBLE), suspicious_indicators, predicted_at FROM scored
),
predictions AS (
  SELECT id, CASE WHEN email_id % 103 = 0 THEN NULL WHEN email_id % 101 = 0 THEN -email_id - 1
                  ELSE email_id END AS email_id,
         model_name, CAST(prediction AS INTEGER) AS prediction, prediction_label,
         CAST(confidence AS DOUBLE) AS confidence, CAST(probability_legitimate AS DOUBLE) AS probability_legitimate,
         CAST(probability_phishing AS DOUBLE) AS probability_phishing, risk_score, suspicious_indicators, timestamp
  FROM fan
)"""

EMAILS = f"""
pm AS (
  SELECT email_id, label, received_at, {strip('raw_text')} AS t, raw_text FROM raw_mails
),
pm2 AS (
  SELECT *, regexp_extract(t, {q(HEADER_LINES)}, 1) AS header_block FROM pm
),
parsed AS (
  SELECT email_id, label, received_at, raw_text, header_block,
    CASE WHEN length(header_block) > 0 THEN regexp_replace(substr(t, length(header_block) + 1), '^\\n', '')
         ELSE t END AS body,
    {header('header_block', 'subject')} AS subject,
    {header('header_block', 'from')} AS sender,
    {header('header_block', 'to')} AS receiver,
    {header('header_block', 'date')} AS date
  FROM pm2
),
emails AS (
  SELECT email_id AS id, {addr_email('sender')} AS sender_email, {addr_name('sender')} AS sender_name,
    receiver AS receiver_email, subject, body,
    array_to_string({nostop(toks(clean('raw_text')))}, ' ') AS processed_text,
    regexp_extract_all(body, {q('(' + L.URL_PATTERN_RANGE + ')')}, 1) AS urls,
    received_at AS timestamp
  FROM parsed
)"""

TRACKER = """
tracker0 AS (
  SELECT event_id AS id, ts AS timestamp,
    CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS prediction,
    CAST(500 + (event_id * 7919) % 501 AS DOUBLE) / 1000 AS confidence,
    event_id, user_id, ts
  FROM events
),
tracker1 AS (
  SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 1 - prediction
                 ELSE prediction END AS actual_label
  FROM tracker0
),
tracker AS (
  SELECT id, timestamp, CAST(prediction AS INTEGER) AS prediction, confidence,
    CAST(actual_label AS INTEGER) AS actual_label,
    CASE WHEN actual_label IS NOT NULL THEN 'initial' END AS user_feedback,
    substr(md5(CAST(user_id AS VARCHAR)), 1, 10) AS email_hash, ts AS created_at,
    CAST(CASE WHEN actual_label IS NULL THEN NULL WHEN prediction = actual_label THEN 1 ELSE 0 END AS INTEGER)
      AS correct
  FROM tracker1
)"""

FEEDBACK = """
feedback AS (
  SELECT event_id AS feedback_id,
    substr(md5(CASE WHEN event_id % 13 = 0 THEN 'unknown-' || CAST(user_id AS VARCHAR)
                    ELSE CAST(user_id AS VARCHAR) END), 1, 10) AS email_hash,
    CAST(event_id % 2 AS INTEGER) AS actual_label, 'user_correction' AS feedback, ts AS feedback_at
  FROM events WHERE event_type = 'signup'
)"""

ACTIVITY = f"""
areq AS (
  SELECT event_id AS id, user_id, event_type AS action, ts AS timestamp,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE ' 198.51.100.' || CAST(user_id % 250 AS VARCHAR) || ', 10.0.0.'
         || CAST(event_id % 250 AS VARCHAR) END AS x_forwarded_for,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE '192.0.2.' || CAST(user_id % 200 AS VARCHAR) END AS remote_addr,
    ({qlist(V.USER_AGENTS)})[event_id % 3 + 1] AS user_agent,
    substr(md5(CAST(user_id AS VARCHAR)), 1, 10) AS email_hash
  FROM events
),
areq2 AS (
  SELECT *, CASE WHEN x_forwarded_for <> '' THEN trim(split_part(x_forwarded_for, ',', 1))
                 ELSE coalesce(remote_addr, 'unknown') END AS ip
  FROM areq
),
activity AS (
  SELECT id, md5(strftime(date_trunc('day', timestamp), '%Y-%m-%dT%H:%M:%S') || '|' || ip) AS session_id, action,
    email_hash AS email_content_hash,
    CASE WHEN action IN ('error', 'click') THEN 'Phishing' WHEN action IN ('view', 'purchase') THEN 'Legitimate' END
      AS prediction_result,
    timestamp, ip AS ip_address, user_agent
  FROM areq2
)"""

_CTES = {
    "raw_mails": (RAW_MAILS, []),
    "scored": (SCORED, ["raw_mails"]),
    "predictions": (PREDICTIONS, ["scored"]),
    "emails": (EMAILS, ["raw_mails"]),
    "tracker": (TRACKER, []),
    "feedback": (FEEDBACK, []),
    "activity": (ACTIVITY, []),
}


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",".join(_CTES[n][0] for n in order) + "\n" + body
