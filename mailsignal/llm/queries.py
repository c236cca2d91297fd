"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from mailsignal.llm import (bpe_codec, chat_format, collocations, language_id, minhash, mixing, quality_classifier, quality_rules, structure_repair, substring_dedup,
                            token_counts, topk, url_filter)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_top_k": lambda spark, d: topk.op1_top_k(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op3_substring_dedup": lambda spark, d: substring_dedup.op3_substring_dedup(_docs(spark, d)),
    "op2_language_id": lambda spark, d: language_id.op2_language_id(_docs(spark, d)),
    "op4_minhash_near_dedup": lambda spark, d: minhash.op4_minhash_near_dedup(_docs(spark, d)),
    "op5_token_counts": lambda spark, d: token_counts.op5_token_counts(_docs(spark, d), _bpe()),
    "op6_bpe_codec": lambda spark, d: bpe_codec.op6_bpe_codec(_docs(spark, d), _bpe()),
    "op7_chat_format": lambda spark, d: chat_format.op7_chat_format(spark.read.parquet(f"{d}/conversations.parquet")),
    "op8_quality_classifier": lambda spark, d: quality_classifier.op8_quality_classifier(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op9_mixing": lambda spark, d: mixing.op9_mixing(_docs(spark, d)),
    "op10_quality_rules": lambda spark, d: quality_rules.op10_quality_rules(_docs(spark, d)),
    "op11_collocations": lambda spark, d: collocations.op11_collocations(_docs(spark, d)),
    "op12_url_filter": lambda spark, d: url_filter.op12_url_filter(spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/labels.parquet")),
    "op13_structure_repair": lambda spark, d: structure_repair.op13_structure_repair(spark.read.parquet(f"{d}/conversations.parquet")),
}

#: CRC-32 of the ASCII string ``k``: each byte is taken in by the first of its eight steps.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, y: CASE WHEN xor(x, y) & 1 = 1 THEN xor(xor(x, y) >> 1, 3988292384::UBIGINT) ELSE xor(x, y) >> 1 END), 4294967295::UBIGINT)"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

#: Tokens of one URL (columns u, host, path), as a sorted list.
_URL_TOKENS = r"""list_sort(list_distinct(['scheme=' || lower(regexp_extract(u, '(?s)^(.*?)://', 1))]
  || list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x)
  || ['top=' || regexp_extract(host, '([^.]*)$', 1)]
  || list_transform(regexp_extract_all(lower(path), '[0-9a-z]+'), lambda x: 'path=' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END)
  || list_transform(regexp_extract_all(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'query=' || x)
  || CASE WHEN contains(u, '#') THEN ['fragment'] ELSE []::VARCHAR[] END))"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _edit(v: str, cost: str, letter: str, line: str | None = None) -> str:
    """The value ``v`` (cost of 8 digits, edits, chr(1), lines) with an edit before it."""
    dearer = f"lpad(({v}[1:8]::INTEGER + {cost})::VARCHAR, 8, '0') || '{letter}'"
    if line is None:
        return f"({dearer} || {v}[9:])"
    return f"({dearer} || {v}[9:strpos({v}, chr(1))] || {line} || chr(10) || {v}[strpos({v}, chr(1)) + 1:])"


def _repair_step() -> str:
    """One row ``y`` (initial, fault, role, text): the best values behind it from nothing, s, u, a -> those before it."""
    more, own = "(CASE WHEN y[2] = 't' THEN 3 ELSE 0 END)", "y[3] || ':' || y[4]"
    stays = lambda x: f"CASE WHEN y[2] NOT IN ('b', 'd') THEN {x} ELSE '90000000' || chr(1) END"
    delete = lambda i: _edit(f"v[{i}]", "4", "D")
    rerole = lambda i, role: stays(_edit(f"v[{i}]", f"3 + {more}", "R", f"'{role}:' || y[4]"))
    keep = lambda i, x: f"CASE WHEN y[1] = '{x}' THEN {stays(_edit(f'v[{i}]', more, 'K', own))} ELSE '90000000' || chr(1) END"
    user, assistant = lambda x: _edit(x, "3", "I", "'user:'"), lambda x: _edit(x, "3", "I", "'assistant:'")
    rows = [f"least({delete(1)}, {rerole(3, 'user')}, {keep(3, 'u')}, {keep(2, 's')})", f"least({delete(2)}, {rerole(3, 'user')}, {keep(3, 'u')})",
            f"least({delete(3)}, {rerole(4, 'assistant')}, {keep(4, 'a')})", f"least({delete(4)}, {rerole(3, 'user')}, {keep(3, 'u')})"]
    turned = f"list_transform([[{', '.join(rows)}]], lambda w: [w[1], w[2], least(w[3], {assistant('w[4]')}), least(w[4], {user('w[3]')})])"
    return f"list_transform({turned}, lambda w: [least(w[1], {user('w[3]')}), least(w[2], {user('w[3]')}), w[3], w[4]])[1]"


_REPAIR_STEP = _repair_step()
_REPAIR_END = ("['00000000' || chr(1), '00000006II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10), "
               "'00000003I' || chr(1) || 'assistant:' || chr(10), '00000000' || chr(1)]")

ORACLE = {
    "op1_top_k": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT rid, doc_id, unnest(w) AS word, unnest(generate_series(1, len(w)::BIGINT)) AS i, len(w)::BIGINT AS n FROM d),
g AS (SELECT *, CASE WHEN i <= n - 12 THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS gram FROM e),
f AS (SELECT gram, min(doc_id) AS first FROM g WHERE gram IS NOT NULL GROUP BY gram),
h AS (SELECT g.*, coalesce(f.first < g.doc_id, false) AS hit FROM g LEFT JOIN f USING (gram)),
c AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT rid, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM c GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)""",
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, hash(gram) AS gram FROM (SELECT rid, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT rid, w, unnest(generate_series(1, greatest(1, len(w)::BIGINT - 4))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
x AS (SELECT a.rid AS p, b.rid AS q, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.rid < b.rid GROUP BY p, q),
e AS (SELECT p, q FROM x JOIN n a ON a.rid = p JOIN n b ON b.rid = q WHERE 100 * c >= 75 * (a.n + b.n - c)),
sym AS (SELECT p, q FROM e UNION SELECT q, p FROM e),
r AS (SELECT rid AS p, rid AS q FROM d UNION SELECT r.p, sym.q FROM r JOIN sym ON r.q = sym.p),
c AS (SELECT p AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.q GROUP BY p)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)""",
    "op7_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS turns,
             15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM n)
SELECT conv_id, any_value(turns)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR i = turns)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
e AS (SELECT rid, unnest(w) AS word, unnest(generate_series(1, len(w)::BIGINT)) AS i, len(w)::BIGINT AS n FROM d),
g AS (SELECT *, CASE WHEN i <= n - 2 THEN string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS g3,
      CASE WHEN i <= n - 11 THEN string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) END AS g12 FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, n, word, g3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g3) > 1 AS r3, g12 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g12) > 1 AS r12 FROM g),
c AS (SELECT rid, bool_or(r3) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, bool_or(r12) OVER (o ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS c12
      FROM f WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT rid, count(*) FILTER (c3) AS three, count(*) FILTER (c12) AS far FROM c GROUP BY rid),
x AS (SELECT rid, CASE WHEN i <= n - 150 THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 150 FOLLOWING) END AS g151
      FROM f WHERE rid IN (SELECT rid FROM m WHERE far > 150)),
long AS (SELECT DISTINCT rid FROM (SELECT rid FROM x WHERE g151 IS NOT NULL GROUP BY rid, g151 HAVING count(*) > 1)),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(three, 0)::BIGINT AS n_repeat_words, coalesce(far, 0) AS far, rid IN (SELECT rid FROM long) AS long
      FROM d LEFT JOIN m USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (far > 0.3 * n_words OR long) AS kept
FROM b""",
    "op11_collocations": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS t FROM documents),
p AS (SELECT rid, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT pid, lang, unnest(w) AS x, unnest(generate_series(1, len(w)::BIGINT)) AS i FROM q WHERE len(w) > 0),
s AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, x AS g FROM s UNION ALL SELECT lang, x || ' ' || y FROM s WHERE y IS NOT NULL
      UNION ALL SELECT lang, x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL) GROUP BY lang, g),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
c AS (SELECT lang, g, c AS a, string_split(g, ' ') AS w FROM f WHERE c >= 10 AND contains(g, ' ')),
k AS (SELECT *, unnest(generate_series(1, len(w)::BIGINT - 1)) AS k FROM c),
v AS (SELECT k.lang, k.g, k.a, k.w, k.k, l.c AS l, r.c AS r, (1000000 * k.a::HUGEINT * k.a::HUGEINT // (l.c::HUGEINT * r.c::HUGEINT))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.g = array_to_string(k.w[:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.g = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x AS (SELECT DISTINCT s.lang, s.g FROM c t, LATERAL (SELECT unnest([t.w[1] || ' ' || t.w[2], t.w[2] || ' ' || t.w[3]]) AS h) JOIN c s ON s.lang = t.lang AND s.g = h
      WHERE len(t.w) = 3 AND len(s.w) = 2 AND 100 * t.a >= 50 * s.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM b ANTI JOIN x USING (lang, g))
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_url_filter": rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT *, {_URL_TOKENS} AS tokens FROM p),
rules(what, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT rid, h || s AS rule, what FROM t JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || s) DESC) = 1),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id AS id, bad, tokens FROM (SELECT * FROM t WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY u) = 1) JOIN marks ON doc_id = page_id),
least AS (SELECT greatest(10, (count(*) * 2 + 999) // 1000) AS least FROM u),
e AS (SELECT id, bad, unnest(tokens) AS token FROM u),
c AS (SELECT token, count(*) AS n, count(*) FILTER (bad) AS b FROM e GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT least FROM least)),
k AS (SELECT id, bad, token FROM e JOIN c USING (token) QUALIFY row_number() OVER (PARTITION BY id ORDER BY b / n DESC, n DESC, token) <= 12),
i AS (SELECT id, bad, [token] AS s FROM k UNION ALL SELECT x.id, x.bad, [x.token, y.token] FROM k x JOIN k y ON x.id = y.id AND x.token < y.token
      UNION ALL SELECT x.id, x.bad, [x.token, y.token, z.token] FROM k x JOIN k y ON x.id = y.id AND x.token < y.token JOIN k z ON y.id = z.id AND y.token < z.token),
g AS (SELECT s, count(*) AS n, count(*) FILTER (bad) AS b FROM i GROUP BY s HAVING count(*) FILTER (bad) >= (SELECT least FROM least) AND 100 * count(*) FILTER (bad) >= 60 * count(*)),
r AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE len(o.s) < len(g.s) AND list_has_all(g.s, o.s) AND o.b * g.n >= g.b * o.n)),
hit AS (SELECT DISTINCT rid FROM t JOIN r ON list_has_all(t.tokens, r.s))
SELECT page_id, host, path, rule, CASE WHEN what IS NOT NULL THEN what WHEN hit.rid IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM t LEFT JOIN m USING (rid) LEFT JOIN hit USING (rid)""",
    "op13_structure_repair": rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS kind FROM k),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'f' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
-- a value is cost (8 digits), edits, a low character and the lines; the list holds the best value from each state: nothing, s, u, a
r AS (SELECT conv_id, list([x, fault, role, text] ORDER BY i DESC) AS l, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND previous || x NOT IN ('su', 'ua', 'au')) AS illegal,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
z AS (SELECT *, list_reduce(l, lambda v, y: {_REPAIR_STEP}, {_REPAIR_END})[1] AS v FROM r)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1:8]::BIGINT, 0) AS cost, coalesce(v[9:strpos(v, chr(1)) - 1], '') AS audit,
       sha256(coalesce(regexp_replace(v[strpos(v, chr(1)) + 1:], '\n$', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
