"""Mail parsing as a table job: header block, body, address split, URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsignal.functions import features as E
from mailsignal.functions import text as T

# A header line is "name: value" with a printable name and no blank; folded
# continuation lines start with a blank or tab. The block ends at the first
# line that is not a header (a blank line is consumed with it). Possessive repeats: no recursion, no retries.
HEADER_BLOCK = r"^((?:[!-9;-~]++:[^\n]*+(?:\n[ \t][^\n]*+)*+(?:\n|$))*+)"
STRIP_WS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def strip_ws(c) -> Column:
    """``str.strip()`` for ASCII whitespace."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), STRIP_WS, "")


def header_value(block: Column, name: str) -> Column:
    """First header ``name`` (case-insensitive) in the block, '' if absent; folded lines are joined by a blank."""
    value = F.regexp_extract(block, r"(?im)^" + name + r":[ \t]*+([^\n]*+(?:\n[ \t][^\n]*+)*+)", 1)
    return F.regexp_replace(value, r"\n[ \t]+", " ")


def split_headers(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Add header_block, body, subject, sender, receiver, date."""
    out = df.withColumn("_t", strip_ws(text_col)).withColumn("header_block", F.regexp_extract("_t", HEADER_BLOCK, 1))
    b = F.col("header_block")
    return (out.withColumn("body", F.when(F.length(b) > 0,
                                          F.regexp_replace(F.substr(F.col("_t"), F.length(b) + 1), r"^\n", ""))
                           .otherwise(F.col("_t")))
            .withColumn("subject", header_value(b, "subject"))
            .withColumn("sender", header_value(b, "from"))
            .withColumn("receiver", header_value(b, "to"))
            .withColumn("date", header_value(b, "date"))
            .drop("_t"))


def address_name(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = F.coalesce(c, F.lit(""))
    name = F.trim(F.regexp_extract(s, r"^([^<]*)<[^<>]*>", 1))
    name = F.regexp_replace(name, r'^"(.*)"$', "$1")
    return F.when(s.rlike(r"<[^<>]*>"), name).otherwise(F.lit(""))


def address_email(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike(r"<[^<>]*>"), F.trim(F.regexp_extract(s, r"<([^<>]*)>", 1))).otherwise(F.trim(s))


def parse_mails(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Full parse: headers, body, sender split and body URL list."""
    out = split_headers(df, text_col)
    return (out.withColumn("sender_name", address_name("sender"))
               .withColumn("sender_email", address_email("sender"))
               .withColumn("urls", E.url_list("body")))


def url_hosts(df: DataFrame, id_col: str = "email_id", urls_col: str = "urls") -> DataFrame:
    """One row per URL with its position and lower-cased host."""
    return (df.select(id_col, F.posexplode(urls_col).alias("pos", "url"))
              .withColumn("host", F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]*)", 1))))


def emails_table(df: DataFrame, text_col: str = "raw_text", id_col: str = "email_id",
                 ts_col: str = "received_at") -> DataFrame:
    """Rows for the ``emails`` table from raw mails (A4); processed_text is the unstemmed chain."""
    p = parse_mails(df, text_col)
    processed = F.array_join(T.drop_stopwords(T.tokens(T.clean_text(F.col(text_col)))), " ")
    return p.select(
        F.col(id_col).alias("id"),
        F.col("sender_email"), F.col("sender_name"),
        F.col("receiver").alias("receiver_email"),
        F.col("subject"), F.col("body"),
        processed.alias("processed_text"),
        F.col("urls"),
        F.col(ts_col).alias("timestamp"),
    )
