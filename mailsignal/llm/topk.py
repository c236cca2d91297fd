"""Exact top-k inner-product search by a three-phase uniform threshold.

Components become integers, ``floor(scale * x)``, so scores are exact. A vector's components are dealt to
``LISTS`` lists; a list holds a candidate's partial inner product with the query, and a candidate's score is
the sum over the lists. Candidates lie in chunks, queries in blocks, and every (chunk, block) meets
once in a grid join: both sides are packed rows of bounded size.

1. Gather: ``GATHER`` chunks (hashes deal vectors to chunks, so these are a fair sample) give the k best entries of each list per query
   and what these few candidates have in the others. The k-th best sum is a safe cutoff, whatever chunks it comes from: k candidates
   reach it.
2. Cutoff: it travels with the query block to all chunks. A candidate that reaches it has in some list at
   least cutoff / LISTS, so entries from that uniform threshold up are sufficient. A list in which no product of norms reaches the
   threshold is not computed. The sum of a candidate's entries, with the threshold in place of each missing one, bounds its score
   from above; those below the cutoff go.
3. Resolve: the missing entries of the candidates left, and only theirs, are looked up in the vectors, and those whose exact score reaches
   the cutoff are ranked, k per query and chunk, then k per query.

Components travel as the smallest integers that hold them.

Null ids, null vectors, and vectors with null or non-finite components take no part. Vectors of different
lengths are not compared. Rows alike in id and vector count once; a query is not its own candidate, whatever its
rows. Two vectors of one query id are asked one by one and their candidates ranked together, so a candidate may stand there twice. Vectors of
any length are taken whole; an empty table gives no rows. Extra columns never matter. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored
from mailsignal.session import ship_package

K, SCALE, LISTS = 10, 1024, 4
GATHER = 2
CHUNK, BLOCK = 4096, 1024
_AT_ONCE = 64  # queries whose scores are held at a time


def _matrix(packed, dim: int):
    """ids and [n, dim] integer components of a packed list, by id."""
    flat = packed.values if not isinstance(packed, pa.ListScalar) else packed.values
    ids = flat.field("v").to_numpy(zero_copy_only=False)
    codes = flat.field("codes")
    values = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    return flat, ids[order], values[order], order


def _exact_kind(queries: np.ndarray, vectors: np.ndarray):
    """Doubles while they hold all integers met, else 64-bit integers."""
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(queries.shape[1], 1)
    return np.float64 if bound < 2 ** 53 else np.int64


def _cuts(dim: int) -> list[tuple[int, int]]:
    at = np.linspace(0, dim, LISTS + 1).astype(int)
    return list(zip(at[:-1], at[1:]))


def _norms(x: np.ndarray, cuts) -> np.ndarray:
    """[list, row] Euclidean norms, a little over."""
    return np.stack([np.sqrt((x[:, a:b].astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) for a, b in cuts])


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the positions ``at``, by falling score, then position (ids rise with it)."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _gathered(lists: list[np.ndarray], other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and sums of the k best entries of each list."""
    entry = np.zeros(len(other), bool)
    for x in lists:
        entry[_best(x, np.flatnonzero(other), k)] = True
    at = np.flatnonzero(entry)
    return at, sum(x[at] for x in lists)


def _sufficient(lists: list, other: np.ndarray, cut: int, look_up) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and exact sums of the candidates that reach the cutoff, and how many entries were looked up for them. A list is None where none of
    its entries can reach the threshold; ``look_up(list, positions)`` gives entries."""
    least = -(-cut // LISTS)  # the uniform threshold
    has = [None if x is None else x >= least for x in lists]
    some = [h for h in has if h is not None]
    at = np.flatnonzero(other & np.logical_or.reduce(some)) if some else np.zeros(0, np.int64)
    above = np.zeros(len(at), np.int64)
    for h, x in zip(has, lists):
        above += least - 1 if h is None else np.where(h[at], x[at], least - 1)
    at = at[above >= cut]
    score, resolved = np.zeros(len(at), np.int64), 0
    for i, (h, x) in enumerate(zip(has, lists)):
        missing = np.ones(len(at), bool) if h is None else ~h[at]
        if h is not None:
            score[~missing] += x[at[~missing]]
        score[missing] += look_up(i, at[missing])
        resolved += int(missing.sum())
    good = score >= cut
    return at[good], score[good], resolved


def _meet(k: int, gather: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                _, ids, vectors, _ = _matrix(batch.column(1)[i], dim)
                flat, asked, queries, order = _matrix(batch.column(2)[i], dim)
                cutoffs = [None] * len(asked) if gather else flat.field("cutoff").take(pa.array(order)).to_pylist()
                kind, cuts = _exact_kind(queries, vectors), _cuts(dim)
                vectors, queries = vectors.astype(kind), queries.astype(kind)
                reach = _norms(vectors, cuts).max(axis=1, initial=0)[:, None] * _norms(queries, cuts)   # [list, query]
                out_q, out_v, out_s = [], [], []
                for lo in range(0, len(asked), _AT_ONCE):
                    some = range(lo, min(lo + _AT_ONCE, len(asked)))
                    local = []
                    for c, (a, b) in enumerate(cuts):
                        needed = any(cutoffs[j] is None or reach[c, j] >= -(-cutoffs[j] // LISTS) for j in some)
                        local.append((queries[lo:lo + _AT_ONCE, a:b] @ vectors[:, a:b].T).astype(np.int64) if needed else None)
                    for j in some:
                        lists = [None if x is None else x[j - lo] for x in local]
                        other = ids != asked[j]
                        if gather:
                            at, score = _gathered(lists, other, k)
                        elif cutoffs[j] is None:
                            at = np.flatnonzero(other)
                            score = sum(x[at] for x in lists)
                        else:
                            look_up = lambda c, at, q=queries[j]: (vectors[at, cuts[c][0]:cuts[c][1]] @ q[cuts[c][0]:cuts[c][1]]).astype(np.int64)
                            at, score, _ = _sufficient(lists, other, cutoffs[j], look_up)
                        best = _best(score, np.arange(len(at)), k)
                        at, score = at[best], score[best]
                        out_q.append(np.full(len(at), asked[j]))
                        out_v.append(ids[at])
                        out_s.append(score)
                join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([join(out_q), join(out_v), join(out_s)], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, chunk: int = CHUNK, block: int = BLOCK,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` (a Column of v) holds."""
    ship_package(vectors.sparkSession)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = vectors.select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).cast("array<double>").alias("e"))
    taken = taken.where(F.col("v").isNotNull() & F.col("e").isNotNull()).where(finite)
    coded = stored(taken.select("v", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("codes")).distinct()
                   .withColumn("dim", F.size("codes")), "vectors")
    largest = F.max(F.greatest(F.abs(F.array_max("codes")), F.abs(F.array_min("codes"))))
    rows = coded.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), largest.alias("x")).collect()   # a row a vector length
    size = {r["dim"]: (-(-r["n"] // chunk), -(-r["q"] // block)) for r in rows if r["q"]}
    most = max((r["x"] or 0 for r in rows), default=0)
    narrow = next((t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if most < 1 << bits), "bigint")
    coded = coded.withColumn("codes", F.col("codes").cast(f"array<{narrow}>"))
    queries = coded.where(is_query)
    if not size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, s in size.items() for x in (d, s[i])]), F.col("dim"))
    dealt = lambda i: F.pmod(F.xxhash64("v", "codes", F.lit(i)), of(i))
    chunks = (coded.where(of(0).isNotNull()).withColumn("chunk", dealt(0)).groupBy("dim", "chunk")
              .agg(F.collect_list(F.struct("v", "codes")).alias("vectors"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), of(1) - 1))))

    def meet(queries: DataFrame, gather: bool) -> DataFrame:
        fields = ["v", "codes"] + ([] if gather else ["cutoff"])
        last = F.least(of(0), F.lit(GATHER)) if gather else of(0)
        blocks = (queries.withColumn("block", dealt(1)).groupBy("dim", "block").agg(F.collect_list(F.struct(*fields)).alias("queries"))
                  .withColumn("chunk", F.explode(F.sequence(F.lit(0), last - 1))))
        cells = (chunks.where(F.col("chunk") < GATHER) if gather else chunks).select("dim", "chunk", F.col("block").cast("long").alias("block"), "vectors").join(
            blocks.select("dim", F.col("chunk").cast("long").alias("chunk"), "block", "queries"), ["dim", "chunk", "block"])
        return cells.select("dim", "vectors", "queries").mapInArrow(_meet(k, gather), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoffs = ranked(meet(queries, True)).where(F.col("rank") == k).select(F.col("query_id").alias("v"), F.col("score").alias("cutoff"))
    cutoffs = stored(cutoffs, "cutoffs")
    return ranked(meet(queries.join(cutoffs, "v", "left"), False)).select("query_id", "rank", "vec_id", "score")


def op1_top_k(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"), F.col("v") % 100 == 0)
