"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

Sketch. A text's distinct 5-word shingles are thrown into ``BINS`` bins: in round i every shingle falls
into one hashed bin with the value (i, hash), and a bin keeps its least value. A text leaves as soon
as all its bins are filled, so rounds beyond the first matter for short texts only; after ``BINS``
rounds bin b of what is left takes the least hash of all shingles under a function of its own. Every
coordinate is filled, two texts agree in one with probability equal to their similarity, and the
number of agreements is as concentrated as for independent functions, at O(shingles + bins log bins).

Candidates. ``BANDS`` bands of ``BINS / BANDS`` coordinates are hashed to buckets. A pair at 0.75 shares none
of 32 bands of 4 with probability 5e-6.

Links without all pairs.
1. Equal word sequences are one class and one vertex; its number is the class's smallest id (where an id has several texts, a code for all but one).
2. Star round: each bucket names its most central member (largest sum of its bucket sizes), and each
   vertex is compared with the most central of its buckets' leaders only. Verified links are joined
   to components.
3. Rest round: buckets whose members lie in one component are done. Among the members of the
   others and their leaders, shingles that only one of them has are counted. Of the n shingles of a vertex
   with the leader it was compared with, a lie in the leader's set and e more are not its own
   alone. Two vertices of one leader share at most min(a) + min(e), any two at most min(a + e). Pairs of
   different components that could still reach the limit under these bounds are all verified, each in the
   first bucket it shares. So no pair of a bucket goes unexamined: it is in one component, or excluded by an
   exact bound, or compared on full sets.

Verification compares the full sets of 64-bit shingle hashes. Texts of candidates are stored once in
the shared folder, whole, of any length. Null text counts as empty; a text without words is linked with nothing. Components are found on
texts. ``op4_minhash_near_dedup`` then counts the rows of one id as one document and joins the components of its texts;
``one_of_each`` keeps one row of each component of texts, so an id with two unlike texts loses neither. A null id is replaced by a
code of its text above every real id (2^62 up; real ids lie below 2^61) and is no component's smallest id unless nothing else is there (then
component_id is null). Empty tables give no rows; extra columns never matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.graph import components, stored
from mailsignal.llm.textscan import LOWER, gram_hashes, mix, slices, span_hashes, within, word_spans
from mailsignal.session import ship_package

SHINGLE = 5
PERCENT = 75
BINS, BANDS = 128, 32
NO_ID, NO_VERTEX = 1 << 62, 1 << 61
_GROUP = 256  # texts sketched at a time: text and bin take 15 bits of a packed word
_SEED = np.random.default_rng(0xB1A5).integers(1, 1 << 63, (2 * BINS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs, ordered by text."""
    buf = LOWER[buf]
    starts, ends, word_offs = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
    at = np.flatnonzero(within(word_offs, k))
    value, owner = gram_hashes(words, k)[at], text[at]
    count = np.diff(word_offs)
    for n in range(1, k):  # fewer than k words: the whole sequence is one shingle
        few = np.flatnonzero(count == n)
        if len(few):
            whole = gram_hashes(words, n)[word_offs[few]]
            value, owner = np.append(value, mix(whole + np.uint64(n))), np.append(owner, few)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def sketches(value: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """[texts, BINS] sketch coordinates; rows of texts without shingles mean nothing."""
    out = np.zeros((texts, BINS), np.uint64)
    bits, low = np.uint64(BINS.bit_length() - 1), np.uint64((1 << 40) - 1)
    for first in range(0, texts, _GROUP):
        lo, hi = np.searchsorted(owner, (first, first + _GROUP))
        x, who = value[lo:hi], owner[lo:hi] - first
        flat = out[first:first + _GROUP].reshape(-1)
        filled = np.zeros(len(flat), bool)
        for i in range(BINS):
            if not len(x):
                break
            h = mix(x * _SEED[i, 0] + _SEED[i, 1])
            packed = (((who.astype(np.uint64) << bits) + (h >> (np.uint64(64) - bits))) << np.uint64(40)) | (h & low)
            packed.sort()
            cell = (packed >> np.uint64(40)).astype(np.int64)
            head = np.ones(len(cell), bool)
            head[1:] = cell[1:] != cell[:-1]
            cell, packed = cell[head], packed[head]
            empty = ~filled[cell]
            flat[cell[empty]] = (packed[empty] & low) | np.uint64(i << 40)
            filled[cell] = True
            some = ~filled.reshape(-1, BINS).all(axis=1)
            stay = some[who]
            x, who = x[stay], who[stay]
        for text in np.unique(who):  # the last rounds: a function of its own for each empty bin
            own = x[who == text]
            for b in np.flatnonzero(~filled[text * BINS:(text + 1) * BINS]):
                flat[text * BINS + b] = (mix(own * _SEED[BINS + b, 0] + _SEED[BINS + b, 1]).min() & low) | np.uint64((BINS + int(b)) << 40)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """[texts, BANDS] bucket keys."""
    rows = BINS // BANDS
    parts = mix(sketch).reshape(len(sketch), BANDS, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sketch_rows(batches):
    for batch in batches:
        for lo, hi, buf, offs in slices(batch.column(1)):
            value, owner = shingles(buf, offs)
            count = np.bincount(owner, minlength=hi - lo)
            keys = band_keys(sketches(value, owner, hi - lo)).view(np.int64)
            lower = LOWER[buf]
            same = [hashlib.md5(b" ".join(lower[offs[i]:offs[i + 1]].tobytes().split())).digest() for i in range(hi - lo)]
            used = count > 0
            offsets = np.concatenate(([0], np.cumsum(np.where(used, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(same, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[used].reshape(-1)))], names=["d", "h", "n", "same", "bands"])


def _shingle_rows(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in slices(batch.column(1)):
            value, owner = shingles(buf, offs)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[lo:hi][owner])], names=["shingle", "v"])


def _verify(percent: int):
    """(a, b, text of a, text of b) -> a, b, shared shingles, and whether they reach the limit."""
    def one(column, i):
        raw = np.frombuffer((column[i].as_py() or "").encode(), np.uint8)
        return shingles(raw, np.array([0, len(raw)]))[0]

    def run(batches):
        last_id, last_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            good, shared = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
            for i in range(len(a)):
                left = one(batch.column(2), i)
                text = batch.column(3)[i].as_py()
                if last_id != text:
                    last_id, last_set = text, one(batch.column(3), i)
                both = len(np.intersect1d(left, last_set, assume_unique=True))
                shared[i] = both
                good[i] = both > 0 and 100 * both >= percent * (len(left) + len(last_set) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared), pa.array(good)], names=["a", "b", "shared", "linked"])
    return run


_COMPARED = "a long, b long, shared long, linked boolean"


def _identified(docs: DataFrame, id_col: str, text_col: str):
    """Id, or for a null one a code of the text."""
    code = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 60) - 1))
    return F.coalesce(F.col(id_col).cast("long"), code)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: d (id or code), h (hash of the text), n_shingles, root (a number of its component of texts; null for
    a text without words)."""
    ship_package(docs.sparkSession)
    base = docs.select(_identified(docs, id_col, text_col).alias("d"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rows = stored(base.mapInArrow(_sketch_rows, "d long, h long, n long, same binary, bands array<long>"), "sketches")
    full = rows.where("n > 0")
    least_id = full.groupBy("same").agg(F.min("d").alias("d"))
    one = full.join(least_id, ["same", "d"]).groupBy("same", "d").agg(F.min(F.struct("h", "n", "bands")).alias("one")).select("same", "d", "one.*")
    first_of = one.groupBy("d").agg(F.min("h").alias("first"))   # an id may be the smallest one of several classes
    code = F.lit(NO_VERTEX) + F.xxhash64("same").bitwiseAND(F.lit((1 << 60) - 1))
    vertices = stored(one.join(first_of, "d").withColumn("v", F.when(F.col("h") == F.col("first"), F.col("d")).otherwise(code)).drop("first"), "vertices")
    classes = vertices.select("same", "v")
    in_band = vertices.select("v", "n", F.explode("bands").alias("key"))
    crowded = in_band.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(in_band.join(crowded, "key").select("key", "v", "n", "size"), "members")

    # star round
    weight = members.groupBy("v").agg(F.sum("size").alias("weight"))
    heads = members.join(weight, "v").groupBy("key").agg(F.max(F.struct("weight", (-F.col("v")).alias("v"))).alias("head"))
    named = members.select("key", "v").join(heads, "key").where(F.col("v") != -F.col("head.v"))
    choice = named.groupBy("v").agg((-F.max("head").getField("v")).alias("leader"))
    choice = weight.select("v").join(choice, "v", "left")
    chosen = choice.join(vertices.select("v", "d", "h"), "v")
    texts = stored(base.join(chosen, ["d", "h"]).select("v", "leader", "t").dropDuplicates(["v"]), "texts")
    own = texts.where("leader is not null").select("v", "leader", "t")
    led = texts.select(F.col("v").alias("leader"), F.col("t").alias("u")).join(own.select("leader").distinct(), "leader", "left_semi")
    compared = stored(own.join(led, "leader").select("v", "leader", "t", "u").mapInArrow(_verify(percent), _COMPARED), "links")
    edges = compared.where("linked").select("a", "b")
    first = stored(components(edges), "roots")

    # rest round
    placed = members.join(first, "v", "left").select("key", "v", "n", F.coalesce("root", "v").alias("root"))
    open_keys = lambda m: m.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    open_ = stored(placed.join(open_keys(placed), "key", "left_semi"), "open")
    near = texts.join(open_.select("v").distinct(), "v", "left_semi")
    there = near.select("v").union(near.where("leader is not null").select("leader")).distinct()
    alone = (texts.join(there, "v", "left_semi").select("v", "t").mapInArrow(_shingle_rows, "shingle long, v long")
             .groupBy("shingle").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v = w")
             .groupBy("v").agg(F.count(F.lit(1)).alias("alone")))
    by_leader = compared.groupBy(F.col("a").alias("v")).agg(F.max("b").alias("leader"), F.max("shared").alias("a"))
    facts = (near.select("v").join(alone, "v", "left").join(by_leader, "v", "left")
             .select("v", "leader", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("a", F.lit(0)).alias("a")))
    # stored step by step: each step uses the one before several times, and its plan would grow with every use
    able = stored(open_.join(facts, "v").withColumn("u", F.col("n") - F.col("alone")).where(100 * F.col("u") >= percent * F.col("n")), "able")
    able = stored(able.join(open_keys(able), "key", "left_semi"), "able")
    able = able.join(able.groupBy("v").agg(F.collect_set("key").alias("keys")), "v")
    most = able.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    able = stored(able.join(most, "key").select("key", "v", "root", "main", "n", "u", "a", "leader", "keys"), "able")
    other = able.where("root <> main").select("key", *[F.col(c).alias(c + "1") for c in ("v", "root", "n", "u", "a", "leader", "keys")])
    most_shared = F.least("u", "u1", F.when(F.col("leader") == F.col("leader1"), F.least("a", "a1") + F.least(F.col("u") - F.col("a"), F.col("u1") - F.col("a1"))))
    pairs = stored(other.join(able, "key").where(
        (F.col("root") != F.col("root1")) & ((F.col("root") == F.col("main")) | (F.col("v1") < F.col("v")))
        & (100 * most_shared >= percent * (F.col("n") + F.col("n1") - most_shared))
        & (F.array_min(F.array_intersect("keys", "keys1")) == F.col("key"))).select(F.col("v1").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
    left = pairs.join(texts.select(F.col("v").alias("a"), "t"), "a")
    more = left.join(texts.select(F.col("v").alias("b"), F.col("t").alias("u")), "b").select("a", "b", "t", "u")
    linked = stored(more.mapInArrow(_verify(percent), _COMPARED).where("linked").select("a", "b"), "links")
    edges = edges.union(linked)
    final = stored(components(edges), "roots")
    member = classes.join(final, "v", "left").select("same", F.coalesce("root", "v").alias("root"))
    some = full.select("d", "h", "n", "same").join(member, "same").select("d", "h", F.col("n").alias("n_shingles"), "root")
    return some.union(rows.where("n = 0").select("d", "h", "n", F.lit(None).cast("long")))


def _real(c: str):
    return F.when(F.col(c) < NO_ID, F.col(c))


def _by_document(found: DataFrame) -> DataFrame:
    """Rows of ``near_duplicates`` -> d, n_shingles, least: the smallest d of the component when rows of one id are one document."""
    found = stored(found, "rows")
    held = found.where("root is not null").select("d", "root").distinct()
    least = held.groupBy("root").agg(F.min("d").alias("least"))
    several = held.groupBy("d").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("d", "a")
    joined = stored(components(held.join(several, "d").where("a <> root").select("a", F.col("root").alias("b"))), "ids")
    top = F.coalesce("top", "root")
    least = least.join(joined.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", top)
    least = least.join(least.groupBy("top").agg(F.min("least").alias("all")), "top").select("root", F.col("all").alias("least"))
    full = found.where("root is not null").join(least, "root").select("d", "n_shingles", "least")
    # a text without words belongs with its id's other texts, if any
    of_id = held.join(least, "root").select("d", "least").distinct()
    bare = found.where("root is null").join(of_id, "d", "left").select("d", "n_shingles", F.coalesce("least", "d").alias("least"))
    return full.union(bare)


def op4_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    out = _by_document(near_duplicates(docs.select("doc_id", "text")))
    return out.select(_real("d").alias("doc_id"), "n_shingles", _real("least").alias("component_id"), (F.col("d") == F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of texts, all columns: the smallest id's, of its texts there the one with the least hash. Texts without words
    stay once an id."""
    found = stored(near_duplicates(docs.select("doc_id", "text")), "rows")
    best = F.min(F.struct("d", "h")).alias("best")
    kept = found.where("root is not null").groupBy("root").agg(best).union(found.where("root is null").groupBy("d").agg(best)).select("best.*").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _identified(docs, "doc_id", "text").alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    # of rows alike in id and text one stays: numbered per task first, so that no task gets all of them
    turn = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    many = rows.join(kept, ["d", "h"]).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    few = many.withColumn("turn", turn("d", "h", "part")).where("turn = 1")
    return few.withColumn("turn", turn("d", "h")).where("turn = 1").select("row.*")
