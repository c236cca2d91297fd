"""Lemma lookup (D6) over token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plural(t: Column) -> Column:
    """Tokens that ``corpus_plural_lemmas`` can have an entry for."""
    return t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3)


def corpus_plural_lemmas(df: DataFrame, toks_col: str) -> DataFrame:
    """(token, lemma) pairs: a token ending in 's' (not 'ss', longer than 3) maps to the form
    without the 's' when that form also occurs in the corpus. One scan: a token counts for itself, and a plural
    also for the form it would come from."""
    t = F.col("t")
    row = lambda form, kind: F.struct(form.alias("form"), F.lit(kind).alias("kind"))
    each = df.select(F.explode(F.array_distinct(toks_col)).alias("t"))
    forms = each.select(F.inline(F.array_compact(F.array(row(t, 1), F.when(plural(t), row(F.left(t, F.length(t) - 1), 2))))))
    both = forms.groupBy("form").agg(F.bit_or("kind").alias("kinds")).where("kinds = 3")
    return both.select(F.concat("form", F.lit("s")).alias("token"), F.col("form").alias("lemma"))


def lemmatize(df: DataFrame, toks_col: str, lemmas: DataFrame, id_col: str, may: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replace each token by its lemma when the (token, lemma) table has one, keeping order (D6). Only a document's distinct tokens
    that may have a lemma move; they come back as one small map a document, which is applied to its tokens in place. ``may``
    tells of a token whether the table can have it, where its rule says so (default: any)."""
    tokens = F.array_distinct(toks_col)
    found = df.select(id_col, F.explode(F.filter(tokens, may) if may else tokens).alias("token")).join(lemmas, "token")
    maps = found.groupBy(F.col(id_col).alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas"))
    j = df.select(id_col, toks_col).join(maps, F.col(id_col) == F.col("_id"), "left")
    replaced = F.transform(toks_col, lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return j.select(id_col, F.when(F.col("_lemmas").isNull(), F.coalesce(toks_col, F.array().cast("array<string>"))).otherwise(replaced).alias("lemmas"))
