"""Phrase collocation mining: the best-scored phrases of two or three words of each language, by best-first growth.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at blanks and tabs. All
counts are per language (null: ``und``). A phrase with a = f(phrase) >= ``min_count`` scores
floor(1000000 a a / (l r)) at its lowest-scoring cut; one whose words lie inside a longer candidate that is at least
``drop_percent`` as frequent is dropped.

Growth. A phrase grows word by word from its prefix, and only while an admissible bound lets it matter:

1. Words with f >= ``min_count`` are the first frontier: no candidate holds another one.
2. Their pairs are counted and scored.
3. A triple x y z scores at most floor(1000000 f(x y) / f(x)) (cut after x, as a <= f(y z)) and at most
   floor(1000000 f(y z) / f(z)). Each language has a threshold, at first the score that ``2 * limit`` pairs reach.
   Triples are grown from the prefixes x y whose bound reaches it, if y z reaches it as well, and from every pair that
   reaches it itself, as such a triple can drop the pair. So everything that scores at or above the threshold is
   known, and known to survive or not. A language with ``limit`` survivors there is settled, ties included; the
   others go on with the threshold that four times as many pairs reach, at last with 0, where nothing is left out.

What to grow is known to the tasks that read texts as bit sets of ``2 ** BITS`` hashed phrases, a fixed size
whatever the corpus holds. A false hit costs a counted phrase that nobody asked for and never changes a count or a result.
Phrases are counted exactly per slice of a text batch (by word numbers), then by string over the cluster, with partial sums before
each shuffle. Products are exact (decimals of 38 digits hold them for counts up to 10^15).

Null texts count as empty; an empty table gives no rows; repeated rows count each time; ties go by a descending, then by
the phrase in byte order. A text is read whole, by numpy in one task (about 60 bytes of memory for each byte of a text longer than a
slice). Extra columns never matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored
from mailsignal.llm.textscan import LOWER, gram_hashes, mix, slices, span_hashes
from mailsignal.session import ship_package

MIN_COUNT, LIMIT, DROP_PERCENT = 10, 2000, 50
SCALE = 1_000_000
SLICE = 1 << 20
ROWS = 1 << 16  # rows of one batch sent on
BITS = 24
UNKNOWN = "und"

_KIND = np.zeros(256, np.uint8)  # 1: blank, 2: end of a piece
_KIND[[0x09, 0x20]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


class _Words:
    """The words of a slice: bytes joined by one blank, start and end there, number of the piece, hash with the language."""

    def __init__(self, buf, offs, langs):
        kind = _KIND[buf]
        inside = kind == 0
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        size = ends - starts
        self.count = len(starts)
        self.text = np.searchsorted(offs, starts, side="right") - 1
        # a text may hold no byte at all, so pieces are told apart by text and by the ends of pieces before the word
        stops = np.concatenate(([0], np.cumsum(kind == 2)))[starts]
        new = np.ones(self.count, bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (stops[1:] != stops[:-1])
        self.piece = np.cumsum(new)
        lower = LOWER[buf]
        self.bytes = np.full(int(size.sum()) + self.count, 0x20, np.uint8)
        self.bytes[np.arange(int(size.sum())) + np.repeat(np.arange(self.count), size)] = lower[inside]
        self.start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        self.end = self.start + size
        self.hash = mix(span_hashes(lower, starts, ends) ^ langs[self.text])
        _, self.word, = np.unique(self.hash, return_inverse=True)
        self.kinds = int(self.word.max()) + 1 if self.count else 0

    def grams(self, k: int) -> np.ndarray:
        """Positions where k words of one piece start."""
        n = self.count - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:k - 1 + n])

    def counted(self, at: np.ndarray, k: int):
        """(one position, count) of each distinct k-gram among those at ``at``."""
        key = self.word[at].astype(np.int64)
        for j in range(1, k):
            _, key = np.unique(key, return_inverse=True)
            key = key * self.kinds + self.word[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return at[first], n

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        a, b = self.start[at], self.end[at + k - 1]
        offs = np.concatenate(([0], np.cumsum(b - a)))
        kind = np.int32 if offs[-1] < 1 << 31 and len(self.bytes) < 1 << 31 else np.int64
        data = self.bytes[np.arange(offs[-1], dtype=kind) - np.repeat((offs[:-1] - a).astype(kind), b - a)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _count_rows(k: int, sets):
    """(lang, text) -> (lang, phrase, n) of each slice; with k = 1 the empty phrase counts all words."""
    names = ["lang", "phrase", "n"]

    def run(batches):
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            langs, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            codes = np.array([_lang_code(g) for g in langs.to_pylist()], np.uint64)[which]
            for lo, hi, buf, offs in slices(batch.column(1), SLICE):
                w = _Words(buf, offs, codes[lo:hi])
                at = w.grams(k)
                if k > 1 and len(at):
                    if k == 2:
                        fine = _hit(sets.value["word"], w.hash)
                        at = at[fine[at] & fine[at + 1]]
                    else:
                        pair = gram_hashes(w.hash, 2)
                        has = {s: _hit(bits, pair) for s, bits in sets.value.items()}
                        x, y = at, at + 1
                        at = at[has["all"][x] & has["all"][y] & ((has["left"][x] & has["right"][y]) | has["top"][x] | has["top"][y])]
                if len(at):
                    every, n = w.counted(at, k)
                    for i in range(0, len(every), ROWS):
                        first = every[i:i + ROWS]
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(which[lo + w.text[first]])), w.strings(first, k), pa.array(n[i:i + ROWS], pa.int64())], names=names)
                if k == 1 and w.count:
                    per, where = np.unique(which[lo + w.text], return_counts=True)
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(per)), pa.array([""] * len(per)), pa.array(where, pa.int64())], names=names)
    return run


def _counts(texts: DataFrame, k: int, sets=None) -> DataFrame:
    rows = texts.mapInArrow(_count_rows(k, sets), "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _positions(k: int):
    """(lang, phrase, flags) -> position in the bit sets, flags."""
    def run(batches):
        for batch in batches:
            langs = np.array([_lang_code(g) for g in batch.column(0).to_pylist()], np.uint64)
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in slices(batch.column(1), SLICE):
                w = _Words(buf, offs, langs[lo:hi])
                hashes = w.hash if k == 1 else gram_hashes(w.hash, 2)[::2]  # a phrase has k words
                at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63, pa.int32()), pa.array(flags[lo:hi])], names=["cell", "bit", "flags"])
    return run


def _bit_sets(phrases: DataFrame, k: int, **members) -> dict[str, np.ndarray]:
    """Bit sets of the rows of (lang, phrase) that are members; at most 2 ** BITS / 64 rows reach the driver."""
    flag = sum((F.when(m, 1 << i).otherwise(0) for i, m in enumerate(members.values())), F.lit(0))
    cells = phrases.select("lang", "phrase", flag.cast("int").alias("flags")).mapInArrow(_positions(k), "cell long, bit int, flags int")
    word = lambda i: F.bit_or(F.when(F.col("flags").bitwiseAND(1 << i) != 0, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")))
    got = cells.groupBy("cell").agg(*[word(i).alias(s) for i, s in enumerate(members)]).toArrow()
    at = got["cell"].to_numpy()
    out = {}
    for s in members:
        out[s] = np.zeros(1 << (BITS - 6), np.uint64)
        out[s][at] = got[s].to_numpy().view(np.uint64)
    return out


def _score(a: str, l: str, r: str):
    return F.expr(f"cast({SCALE} * cast({a} as decimal(20,0)) * cast({a} as decimal(20,0)) div (cast({l} as decimal(20,0)) * cast({r} as decimal(20,0))) as long)")


def _pairs(texts: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates of two words."""
    sets = texts.sparkSession.sparkContext.broadcast(_bit_sets(words, 1, word=F.lit(True)))
    pairs = _counts(texts, 2, sets).where(F.col("n") >= min_count).select("lang", "phrase", F.col("n").alias("a"),
                F.substring_index("phrase", " ", 1).alias("x"), F.substring_index("phrase", " ", -1).alias("y"))
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l")), ["lang", "x"])
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r")), ["lang", "y"])
    return stored(pairs.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score")), "pairs")


def _triples(texts: DataFrame, pairs: DataFrame, near: DataFrame, min_count: int) -> DataFrame:
    """Candidates of three words that ``near`` (pairs with their language's threshold) lets grow, with their pairs."""
    reach = lambda c: F.expr(f"{SCALE} * cast(a as decimal(20,0)) div {c}") >= F.col("theta")
    sets = _bit_sets(near, 2, all=F.lit(True), left=reach("l"), right=reach("r"), top=F.col("score") >= F.col("theta"))
    some = _counts(texts, 3, texts.sparkSession.sparkContext.broadcast(sets)).where(F.col("n") >= min_count)
    some = some.select("lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("x"), F.substring_index("phrase", " ", -2).alias("y"))
    some = some.join(near.select("lang", F.col("phrase").alias("x"), F.col("a").alias("xy"), F.col("l").alias("one")), ["lang", "x"])
    some = some.join(near.select("lang", F.col("phrase").alias("y"), F.col("a").alias("yz"), F.col("r").alias("three"), "theta"), ["lang", "y"])
    first, second = _score("a", "one", "yz"), _score("a", "xy", "three")
    early = first <= second
    return stored(some.select("lang", "phrase", "a", F.when(early, F.col("one")).otherwise(F.col("xy")).alias("l"),
                              F.when(early, F.col("yz")).otherwise(F.col("three")).alias("r"), F.least(first, second).alias("score"), "x", "y", "theta"), "triples")


def _thresholds(pairs: DataFrame, langs: DataFrame, reached: int) -> DataFrame:
    """lang, theta: the largest score that ``reached`` pairs of the language have at least; 0 where there are fewer."""
    histogram = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("c"))  # scores are whole numbers up to SCALE: bounded
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    at = histogram.withColumn("so_far", F.sum("c").over(down)).where(F.col("so_far") >= reached).groupBy("lang").agg(F.max("score").alias("theta"))
    return langs.join(at, "lang", "left").select("lang", F.coalesce("theta", F.lit(0)).alias("theta"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, limit: int = LIMIT, drop_percent: int = DROP_PERCENT,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``limit`` phrases of each language."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).where(F.col("text") != "")
    words = stored(_counts(texts, 1).where((F.col("n") >= min_count) | (F.col("phrase") == "")), "words")
    totals = words.where("phrase = ''").select("lang", F.col("n").alias("all_words"))
    pairs = _pairs(texts, words.where("phrase <> ''"), min_count)
    kept = [F.col(c) for c in ("lang", "phrase", "a", "l", "r", "score")]
    left, reached, settled = stored(pairs.select("lang").distinct(), "langs"), 2 * limit, None
    while not left.isEmpty():
        near = stored(pairs.join(_thresholds(pairs, left, reached), "lang"), "near")
        triples = _triples(texts, pairs, near, min_count)
        inside = (triples.select("lang", F.explode(F.array("x", "y")).alias("phrase"), "a")
                  .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
        top = near.where("score >= theta").join(inside, ["lang", "phrase"], "left")
        alive = top.where(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a")))
        alive = stored(alive.select(*kept, "theta").union(triples.where("score >= theta").select(*kept, "theta")), "alive")
        state = near.groupBy("lang").agg(F.max("theta").alias("theta")).join(alive.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "lang", "left")
        state = stored(state.withColumn("done", (F.col("theta") == 0) | (F.coalesce("c", F.lit(0)) >= limit)).select("lang", "done"), "state")
        now = alive.join(state.where("done").select("lang"), "lang", "left_semi").select(*kept)
        settled = now if settled is None else settled.union(now)
        left, reached = stored(state.where("not done").select("lang"), "langs"), 4 * reached
    if settled is None:
        settled = pairs.select(*kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part first, so that no task gets all phrases of a language
    part = settled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def op11_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)
