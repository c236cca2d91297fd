"""Substring dedup by seed and extend: remove passages that an earlier document already holds.

0. Copies. A text equal to that of a smaller document is removed whole (if it has a window at all) and is
   no one's smallest holder, so it sends nothing.
1. Seeds. Of the word k-grams in each window of ``min_words`` words the one with the least hash is
   winnowed out; two equal windows have the same seed, so every repeat of that length holds a common
   one. A document sends each of its seeds once.
2. Join. Documents meet on their seeds; a seed of one document only is dropped, which leaves a small
   part of the corpus.
3. Extend. Every shared seed is extended both ways to all windows of ``min_words`` words that have it
   as their seed, and a window is matched against the smallest document holding the same window
   (128 hash bits). Windows with a smaller holder unite to the maximal repeats of at least
   ``min_words`` words, which are cut out.

Hot seeds and windows: every task first settles what it can among its own texts (the combiner), and
sends on one row for each of its distinct keys; settled rows get a key of their own. No group is
collected: the meeting is a window's min and max over (key, document) rows, and lists are gathered
by document only. Texts move once; both joins read the same exchange.

Null text counts as empty. A null id is neither smaller nor larger than another: such rows keep all
their words and cut none elsewhere. Rows of the same id are one document in different states: none
cuts the other. Texts are cut whole, at any length; an empty table gives no rows. Extra columns ride along in ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsignal.llm.textscan import gram_hashes, mix, slices, span_hashes, within, word_spans
from mailsignal.session import ship_package

MIN_WORDS = 13
SEED_WORDS = 7
RUN_BYTES = 4 << 20


def _words(buf, offs):
    starts, ends, word_offs = word_spans(buf, offs)
    return span_hashes(buf, starts, ends), word_offs


def _windows(words, word_offs, size: int, seed: int):
    """Start, text and seed of each window that lies in one text."""
    ok = within(word_offs, size)
    n = len(ok)
    text = np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))[:n]
    least = np.zeros(0, np.uint64)
    if n:
        grams = gram_hashes(words, seed)
        least = grams[:n].copy()
        for j in range(1, size - seed + 1):
            np.minimum(least, grams[j:j + n], out=least)
    at = np.flatnonzero(ok)
    return at, text[at], least[at]


def _ids(batch, lo, hi):
    """The ids of rows lo to hi and which are not null."""
    column = batch.column(0).slice(lo, hi - lo)
    return column.fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False)


def _rows(key, value, ids, known):
    """Arrow rows; ``value`` is left null where it is the key itself."""
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(value.view(np.int64), mask=key == value), pa.array(ids), pa.array(known)],
        names=["key", "value", "d", "known"])


def _own_key(value, ids):
    """A key of its own for each settled row, so that those of one hot value spread."""
    return mix(value + ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _first_of(*sorted_keys):
    change = np.ones(len(sorted_keys[0]), bool)
    if len(change):
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return change


def _seed_rows(size: int, seed: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                ids, real = _ids(batch, lo, hi)
                _, text, seeds = _windows(*_words(buf, offs), size, seed)
                use = _first_of(text, seeds) & real[text]
                d, seeds = ids[text[use]], seeds[use]
                order = np.lexsort((d, seeds))
                d, seeds = d[order], seeds[order]
                once = _first_of(seeds, d)
                d, seeds = d[once], seeds[once]
                head = _first_of(seeds)
                group = np.cumsum(head) - 1
                known = np.bincount(group)[group] > 1 if len(group) else head
                yield _rows(np.where(head, seeds, _own_key(seeds, d)), seeds, d, known)
    return run


def _window_rows(size: int, seed: int):
    """As ``_seed_rows``, of the windows whose seed is shared; a row with a value is settled."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                ids, real = _ids(batch, lo, hi)
                shared = lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), shared.value_lengths().fill_null(0).to_numpy())
                if not len(owner):
                    continue
                mine = _own_key(shared.flatten().to_numpy().astype(np.int64).view(np.uint64), owner)
                words, word_offs = _words(buf, offs)
                at, text, seeds = _windows(words, word_offs, size, seed)
                use = real[text] & np.isin(_own_key(seeds, text), mine)
                at, d = at[use], ids[text[use]]
                one, two = gram_hashes(words, size)[at], gram_hashes(words, size, 1)[at]
                order = np.lexsort((d, two, one))
                one, two, d = one[order], two[order], d[order]
                once = _first_of(one, two, d)
                one, two, d = one[once], two[once], d[once]
                head = _first_of(one, two)
                # but for the head of a group, a smaller document of this run has the window
                rows = _rows(np.where(head, one, _own_key(one, d)), one, d, head)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(two.view(np.int64))], names=["key", "value", "d", "check"])
    return run


def _cut(size: int, seed: int, layout: bool):
    """Carried columns, text, gone windows, whether a copy -> carried columns, kept text, counts, spans. With
    ``layout`` a text that loses nothing stays as it is."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                gone, copy = lists.slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo).to_pylist()
                owner = np.repeat(np.arange(hi - lo), gone.value_lengths().fill_null(0).to_numpy())
                counts, removed, texts, spans = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), [], []
                words, word_offs = _words(buf, offs) if len(owner) else (None, None)
                drop = np.zeros(0, bool)
                if len(owner):
                    mine = _own_key(gone.flatten().to_numpy().astype(np.int64).view(np.uint64), owner)
                    at = np.flatnonzero(within(word_offs, size))
                    text = np.repeat(np.arange(hi - lo), np.diff(word_offs))[at]
                    at = at[np.isin(_own_key(gram_hashes(words, size)[at], text), mine)]
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[at] += 1
                    edge[at + size] -= 1  # starts are distinct, so are ends
                    drop = np.cumsum(edge[:-1]) > 0
                for i in range(hi - lo):
                    whole = buf[offs[i]:offs[i + 1]].tobytes()
                    every = whole.split()
                    counts[i] = len(every)
                    mark = drop[word_offs[i]:word_offs[i + 1]] if len(owner) else drop
                    if copy[i] and len(every) >= size:
                        mark = np.ones(len(every), bool)
                    if mark.any():
                        removed[i] = int(mark.sum())
                        step = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in step.reshape(-1, 2)])
                        every = [w for w, out in zip(every, mark.tolist()) if not out]
                    else:
                        spans.append([])
                    texts.append(whole if layout and not removed[i] else b" ".join(every))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.utf8()), pa.array(counts), pa.array(removed),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["row", "kept_text", "n_words", "n_removed", "spans"])
    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS,
                   id_col: str = "doc_id", text_col: str = "text", layout: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of its columns but the text), ``kept_text`` (kept words
    joined by one space), ``n_words``, ``n_removed``, and ``spans`` (word positions of the removed maximal
    repeats, end exclusive). With ``layout`` texts that lose nothing keep their white space."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("t"),
                       F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"))
    # a copy is told by its text's hash in the list of its id: all joins are on the id alone and read one exchange
    named = base.where("d is not null and t is not null").select("d", "h", F.sha2("t", 256).alias("sha"))
    first = named.groupBy("sha").agg(F.min("d").alias("first"))
    copies = named.join(first, "sha").where("d > first").groupBy("d").agg(F.collect_set("h").alias("twins"))
    marked = base.join(copies, "d", "left").withColumn("copy", F.coalesce(F.array_contains("twins", F.col("h")), F.lit(False)))
    meet = marked.where(~F.col("copy")).select("d", "t", "row").mapInArrow(_seed_rows(min_words, seed_words), "key long, value long, d long, known boolean")
    w = Window.partitionBy("key")
    seeds = (meet.withColumn("shared", F.col("known") | (F.min("d").over(w) < F.max("d").over(w))).where("shared")
             .groupBy("d").agg(F.collect_list(F.coalesce("value", "key")).alias("seeds")))
    # "row" is passed along unused: with the same columns, the joins read one exchange of the texts
    found = (base.join(seeds, "d", "left").select("d", "t", "seeds", "row", "h")
             .mapInArrow(_window_rows(min_words, seed_words), "key long, value long, d long, check long"))
    w = Window.partitionBy("key", "check")
    gone = (found.withColumn("earlier", F.col("value").isNotNull() | (F.min("d").over(w) < F.col("d"))).where("earlier")
            .groupBy("d").agg(F.collect_list(F.coalesce("value", "key")).alias("gone")))
    schema = T.StructType([base.schema["row"], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return marked.join(gone, "d", "left").select("row", "t", "gone", "copy").mapInArrow(_cut(min_words, seed_words, layout), schema)


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of the texts; ``n_chars`` (where there is one) follows the new text,
    rows of which nothing is left are dropped, texts that lose nothing stay as they are."""
    out = remove_repeats(docs, layout=True).where("n_words > n_removed")
    fresh = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[(fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
