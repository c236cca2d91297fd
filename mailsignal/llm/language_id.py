"""Language ID by prediction by partial matching: exact code lengths under frozen byte context trees.

Training. For each language the byte strings of 1 to ``ORDER`` + 1 bytes in its training texts are counted: a context tree
with the counts of what followed each context. Contexts seen fewer than ``MIN_COUNT`` times are cut, so depth
varies. Texts are whole, ASCII and Latin-1 letters are folded to lower case, and the sample is bounded: at
most ``TEXTS`` documents per language, those with the least hash of their id among the lowest few of all.

Code length. After context c with n followers, q of them distinct, byte s costs -log2(n(s) / (n + q)); an unseen s
costs the escape -log2(q / (n + q)) and what it costs after c without its first byte; at last 8 bits. Counts
stay frozen while scoring, so a byte's cost depends on it and the ``ORDER`` bytes before it only, and every cost
is a table entry.

Scoring. The trees of all languages share their nodes. A text's bytes walk the shared tree order by order, as arrays
(the node of a string is the child of the node of all but its last byte); the deepest node and the
escapes above it give the cost in every language. The shortest code wins, ties go to the first language in
code-point order. ``score`` is the winner's posterior under equal priors.

No shuffle of texts: training gathers a bounded table of counts, which every task turns into its tables. Null text,
or text without a letter: ``und``, score 0. So too if there is nothing to learn from. Rows are predicted one
by one, whole at any length; an empty table gives no rows; extra columns never matter. The table of counts is bounded per language (``TEXTS``
texts each), not in the number of languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.textscan import LOWER, slices
from mailsignal.session import ship_package

ORDER = 3
MIN_COUNT = 2
TEXTS = 300
UNKNOWN = "und"


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and, in UTF-8, of Latin-1 letters."""
    out = LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    out[at] += 32
    return out


def _strings(buf: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """All strings of ``size`` bytes within one text, as integers."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(size):
        code = (code << 8) | buf[j:j + n]
    left = np.repeat(offs[1:], np.diff(offs))[:n] - np.arange(n)
    return code[left >= size]


def _count_rows(batches):
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, buf, offs in slices(batch.column(1)):
            buf = folded(buf)
            own = langs[lo:hi]
            for lang in sorted(set(own)):
                rows = np.flatnonzero(own == lang)
                part = np.concatenate([buf[offs[i]:offs[i + 1]] for i in rows])
                bounds = np.concatenate(([0], np.cumsum([offs[i + 1] - offs[i] for i in rows]))).astype(np.int64)
                for size in range(1, ORDER + 2):
                    code, n = np.unique(_strings(part, bounds, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), size, np.int32)), pa.array(code), pa.array(n)],
                        names=["lang", "size", "code", "n"])


def train(labelled: DataFrame, texts: int = TEXTS) -> list[tuple]:
    """(lang, size, code, n) rows of the context trees of a bounded sample of (doc, text, lang)."""
    ship_package(labelled.sparkSession)
    known = labelled.where("lang is not null and text is not null and doc is not null")
    # a hash below a language's threshold first: of a hot language only about 4 * texts ids meet in one task
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << 40))
    distinct = known.select("doc", "lang").distinct()
    share = distinct.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * texts / F.count(F.lit(1))).alias("share"))  # one row per language
    low = distinct.join(F.broadcast(share), "lang").where(place < F.col("share") * F.lit(float(1 << 40)))
    least = Window.partitionBy("lang").orderBy(place, "doc")
    ids = low.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= texts).select("doc", "lang")
    sample = known.join(F.broadcast(ids), ["doc", "lang"])  # at most ``texts`` ids per language
    counts = sample.select("lang", "text").mapInArrow(_count_rows, "lang string, size int, code long, n long")
    counts = counts.groupBy("lang", "size", "code").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_COUNT) | (F.col("size") == 1))
    return [tuple(r) for r in counts.orderBy("lang", "size", "code").collect()]


class Model:
    """Context trees with shared nodes. Node 0 is unknown, 1 the root; contexts come first, so that only they need rows of children."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[0] for r in rows})
        col = {x: i for i, x in enumerate(self.langs)}
        by = {size: [r for r in rows if r[1] == size] for size in range(1, ORDER + 2)}
        codes = {0: np.zeros(1, np.int64)} | {s: np.unique(np.array([r[2] for r in by[s]], np.int64)) for s in by}
        first = np.cumsum([1] + [len(codes[s]) for s in range(ORDER + 2)])
        self.child = np.zeros((first[ORDER + 1]) * 256, np.int32)
        seen = {s: np.zeros((len(codes[s]), len(col))) for s in range(1, ORDER + 2)}
        for s, group in by.items():
            if group:
                np.add.at(seen[s], (np.searchsorted(codes[s], [r[2] for r in group]), [col[r[0]] for r in group]), [float(r[3]) for r in group])
        total = int(first[-1])
        # escape[c]: cost of leaving context c; cost[node]: of its last byte after the rest of its string
        self.escape, self.cost = np.zeros((total, len(col))), np.zeros((total, len(col)))
        lower = np.full((256, len(col)), 8.0)  # order -1
        parent_of = {}
        for s in range(1, ORDER + 2):
            found = np.searchsorted(codes[s - 1], codes[s] >> 8)
            found = np.minimum(found, len(codes[s - 1]) - 1)
            parent = np.where(codes[s - 1][found] == codes[s] >> 8, first[s - 1] + found, 0)
            node = first[s] + np.arange(len(codes[s]))
            has = parent > 0
            self.child[parent[has] * 256 + (codes[s][has] & 255)] = node[has]
            n, q = np.zeros((total, len(col))), np.zeros((total, len(col)))
            np.add.at(n, parent[has], seen[s][has])
            np.add.at(q, parent[has], (seen[s][has] > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.unique(parent[has])
                self.escape[here] = np.where(q[here] > 0, -np.log2(q[here] / (n[here] + q[here])), 0.0)
                known = -np.log2(seen[s] / (n[parent] + q[parent]))
            if s == 1:
                shorter = lower[codes[1]]
            else:
                rest = codes[s] & ((1 << 8 * (s - 1)) - 1)
                at = np.minimum(np.searchsorted(codes[s - 1], rest), len(codes[s - 1]) - 1)
                shorter = self.cost[first[s - 1] + at]
            self.cost[node] = np.where((seen[s] > 0) & has[:, None], known, self.escape[parent] + shorter)
        self.cost[0] = self.escape[1] + 8
        self.cost = np.ascontiguousarray(self.cost.T.astype(np.float32))
        self.escape = np.ascontiguousarray(self.escape.T.astype(np.float32))

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """[texts, languages] code lengths in bits."""
        buf = folded(buf).astype(np.int64)
        n, start = len(buf), offs[:-1][np.diff(offs) > 0]
        nodes = []
        for k in range(ORDER + 1):
            if k:
                before = np.zeros(n, np.int64)
                before[1:] = nodes[-1][:-1]
                before[start] = 0
                nodes.append(self.child[before * 256 + buf].astype(np.int64))
            else:
                nodes.append(self.child[256 + buf].astype(np.int64))
        deepest = nodes[0].copy()
        for level in nodes[1:]:
            np.copyto(deepest, level, where=level > 0)
        lost = []  # (positions, contexts that were left by an escape)
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((nodes[k] == 0) & (np.arange(n) > 0))
            context = nodes[k - 1][at - 1]
            inside = context > 0
            at, context = at[inside], context[inside]
            fresh = np.zeros(n, bool)
            fresh[start] = True
            ok = ~fresh[at]
            lost.append((at[ok], context[ok]))
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for i in range(len(self.langs)):
            cost = self.cost[i][deepest].astype(np.float64)
            for at, context in lost:
                cost[at] += self.escape[i][context]
            total = np.concatenate(([0.0], np.cumsum(cost)))
            out[:, i] = total[offs[1:]] - total[offs[:-1]]
        return out


def _predict_rows(rows: list[tuple]):
    packed = (sorted({r[0] for r in rows}), np.array([r[1:] for r in rows], np.int64).reshape(-1, 3), [r[0] for r in rows])

    def run(batches):
        langs, numbers, owner = packed
        model = Model([(o, *map(int, x)) for o, x in zip(owner, numbers)]) if langs else None
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1)):
                usable = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                pred, score = np.array([UNKNOWN] * (hi - lo), object), np.zeros(hi - lo)
                if model is not None and usable.any():
                    bits = model.lengths(buf, offs)
                    least = bits.min(axis=1, keepdims=True)
                    winner = bits.argmin(axis=1)
                    sure = 1 / np.exp2(np.maximum(least - bits, -1000.0)).sum(axis=1)
                    pred = np.where(usable, np.array(langs, object)[winner], UNKNOWN)
                    score = np.where(usable, np.clip(sure, 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(pred), pa.string()), pa.array(score)],
                                                 names=["key", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, rows: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score of each whole text under the trees ``rows``."""
    ship_package(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return taken.mapInArrow(_predict_rows(rows), f"key {taken.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(docs: DataFrame) -> DataFrame:
    labelled = docs.where(~held_out()).select(F.col("doc_id").alias("doc"), "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(labelled))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
