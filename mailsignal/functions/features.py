"""Scalar indicator columns (links, senders, wording, punctuation, capitals).

All are built-in expressions so a whole feature family is one projection inside
whole-stage codegen; ``lower(text)`` is shared by common-subexpression
elimination.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsignal import lexicon as L
from mailsignal.functions.text import URL_NONSPACE, whitespace_tokens


# The URL finders of the lexicon as one character class with possessive repeats. Java matches a repeated group
# by recursion, and one long URL would end in a stack overflow; these match the same strings without.
# The range $-_ holds the digits, '%', ':' and '/'.
URL_RANGE = r"http[s]?://[a-zA-Z$-_@.&+!*\\(\\),]++"
URL_ESCAPED = r"http[s]?://(?:[a-zA-Z0-9$\-_@.&+!*\\(\\),]++|%[0-9a-fA-F][0-9a-fA-F])++"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _txt(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def count_substr(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``), as bigint."""
    t = _txt(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def char_count(c) -> Column:
    return F.length(_txt(c)).cast("bigint")


def word_count(c) -> Column:
    return F.size(whitespace_tokens(c)).cast("bigint")


def sentence_count(c) -> Column:
    return F.regexp_count(_txt(c), F.lit(r"[.!?]+")).cast("bigint")


def regex_count(c, pattern: str) -> Column:
    return F.regexp_count(_txt(c), F.lit(pattern)).cast("bigint")


def url_count_range(c) -> Column:
    return regex_count(c, URL_RANGE)


def url_count_escaped(c) -> Column:
    return regex_count(c, URL_ESCAPED)


def url_count_http(c) -> Column:
    """Occurrences of 'http', case-sensitive (live metadata vector)."""
    return count_substr(c, "http")


def url_count_nonspace(c) -> Column:
    return regex_count(c, URL_NONSPACE)


def url_list(c) -> Column:
    return F.regexp_extract_all(_txt(c), F.lit(URL_RANGE), 0)


def caps_runs(c) -> Column:
    return regex_count(c, r"[A-Z]{3,}")


def upper_count(c) -> Column:
    return F.regexp_count(_txt(c), F.lit(r"\p{IsUppercase}")).cast("bigint")


def caps_ratio(c) -> Column:
    return upper_count(c).cast("double") / (F.length(_txt(c)) + 1).cast("double")


def has_ip_loose(c) -> Column:
    return _txt(c).rlike(L.IP_PATTERN_LOOSE)


def has_ip_bounded(c) -> Column:
    return _txt(c).rlike(L.IP_PATTERN_BOUNDED)


def has_shortener_in_urls(urls) -> Column:
    """Any of four shortener domains as a substring of an extracted URL."""
    return F.exists(_c(urls), lambda u: _any([u.contains(d) for d in L.SHORTENERS_4]))


def has_shortener_in_text(c) -> Column:
    low = F.lower(_txt(c))
    return _any([low.contains(d) for d in L.SHORTENERS_5])


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def keyword_hits(c, words: list[str]) -> Column:
    """Number of distinct list entries occurring in the lower-cased text."""
    low = F.lower(_txt(c))
    total = None
    for w in words:
        term = F.when(low.contains(w), F.lit(1)).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total.cast("bigint")


def found_keywords(c, words: list[str]) -> Column:
    """The list entries found, in list order."""
    low = F.lower(_txt(c))
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def sender_suspicious(c) -> Column:
    return F.lower(_txt(c)).rlike("|".join(L.SENDER_PATTERNS))


def metadata_vector_columns(text_col="text") -> list[Column]:
    """The live 8-column metadata vector, in its fixed order."""
    t = _c(text_col)
    return [
        char_count(t).alias("email_length"),
        word_count(t).alias("word_count"),
        url_count_http(t).alias("url_count"),
        count_substr(t, "!").alias("exclamation_count"),
        count_substr(t, "?").alias("question_count"),
        count_substr(t, "$").alias("dollar_count"),
        keyword_hits(t, L.URGENT_4).alias("urgent_words"),
        keyword_hits(t, L.KEYWORDS_5).alias("suspicious_keywords"),
    ]


METADATA_NAMES = ["email_length", "word_count", "url_count", "exclamation_count",
                  "question_count", "dollar_count", "urgent_words", "suspicious_keywords"]
