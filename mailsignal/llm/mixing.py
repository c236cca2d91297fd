"""Mixing sources to target weights by entropy balancing.

Targets. Sources, in code-point order with null last, weigh 3, 1, 2, 3, 1, 2, ... and share ``share`` times all
words; a target stops at ``most`` times its source's words, and the excess is shared again by
weight until none is above. With sources ordered by cap / weight the stopped ones are a prefix, so
running sums over one row per source give the level that the others share. Places and running sums come from range partitions
(``operators.ranking``), so there may be one source a host.

Rates. Among all document rates in (0, ``most``) that meet a source's token constraint, those of the
greatest (bounded) entropy are ``most / (1 + exp(-lambda * size / mean size))``: the logit is tilted
exponentially with the document's tokens, the multiplier is the solution of a convex dual in one unknown per source.
Newton steps solve all sources at once, each step one aggregate over a (source, size, documents)
histogram joined with the present multipliers; a bracket guards the steps and halves where they fail, down to neighbouring doubles. A solve that
needs more than ``MAX_STEPS`` raises an error.

Copies. Rates become whole copies by carrying the rounding error from one document to the next, within blocks
of a source of about ``BLOCK`` documents, from the longest to the shortest. A block ends within about half
its shortest text of its share, however large the source is, and a hot source is many
blocks. The blocks follow a hash of id and text, so reruns agree. Rows alike in id, text and source are one row with a count until their
copies are known, which they share out evenly.

Null text has size 0; a document of size 0 takes nothing and gets no copies. Null is a source of its own. Sizes are counted on whole texts of any
length; an empty table gives no rows. Extra columns never matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored
from mailsignal.operators.ranking import rank_within, running_sum

SHARE, MOST, WEIGHTS = 1.5, 2.0, (3, 1, 2)
BLOCK = 4096
TOLERANCE, MAX_STEPS = 1e-9, 400
SPREAD = 4096  # rows alike that are told apart in one place


def targets(totals: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, total) -> and target. One row per source throughout."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))   # code points, null last
    t = rank_within(totals.withColumn("key", key), None, ["key"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("cap", most * F.col("total")).withColumn("at", F.col("cap") / F.col("weight")).withColumn("all", F.lit(1))
    t = running_sum(t, "all", ["at", "key"], "cap", "cap_before")
    t = stored(running_sum(t, "all", ["at", "key"], "weight", "weight_before"), "sources")
    sums = t.groupBy("all").agg(F.sum("total").alias("words"), F.sum("weight").alias("weights"))   # one row
    t = t.join(sums, "all").withColumn("level", (share * F.col("words") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    t = t.withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    shared = t.groupBy("all").agg(F.min(F.struct("full", "at", "key", "level"))["level"].alias("shared"))   # of the first source that is not stopped
    return t.join(shared, "all").withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("shared") * F.col("weight")))).select("source", "total", "target")


def _rate(most: float):
    return most / (1 + F.exp(-F.col("multiplier") * F.col("size") / F.col("mean")))


def multipliers(histogram: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """(source, size, n) and (source, total, target) -> wanted with mean and multiplier.

    ``free`` sources have a target strictly between 0 and ``most`` times their words; the others need no
    multiplier (every rate is 0 or ``most``)."""
    mean = (histogram.where("size > 0").groupBy(F.col("source").alias("s"))
            .agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")))
    state = (wanted.join(mean, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
             .withColumn("free", (F.col("target") > 0) & (F.col("target") < most * F.col("total") * (1 - 1e-12)))
             .withColumns({"multiplier": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))}))
    state = stored(state, "multipliers")
    for _ in range(MAX_STEPS):
        h = histogram.withColumnRenamed("source", "s")
        rate = _rate(most)
        sums = (h.join(state.where("free"), F.col("s").eqNullSafe(F.col("source"))).groupBy("s")
                .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                     F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate * (1 - rate / most)).alias("slope")))
        moved = state.join(sums, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
        gap = F.col("got") - F.col("target")
        x = F.col("multiplier")
        low = F.when(gap < 0, x).otherwise(F.col("low"))
        high = F.when(gap > 0, x).otherwise(F.col("high"))
        step = x - F.try_divide(gap, F.col("slope"))
        middle = (F.when(low == float("-inf"), 2 * high - 1).when(high == float("inf"), 2 * low + 1).otherwise((low + high) / 2))
        good = F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > low) & (step < high) & (F.abs(step - x) < 2 + F.abs(x))
        narrow = (high - low) <= 1e-15 * (1 + F.abs(x))   # no double between them
        done = F.coalesce((F.abs(gap) <= TOLERANCE * F.col("target")) | narrow, F.lit(True))
        state = stored(moved.withColumns({"done": done, "low": F.when(done, F.col("low")).otherwise(low), "high": F.when(done, F.col("high")).otherwise(high),
                                          "multiplier": F.when(done, x).when(good, step).otherwise(middle)})
                       .select("source", "total", "target", "mean", "free", "multiplier", "low", "high", "done"), "multipliers")
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    else:
        raise RuntimeError(f"entropy balancing has not converged in {MAX_STEPS} steps")
    return state.select("source", "total", "target", "mean", "free", "multiplier")


def _copies(most: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc", "code"], ascending=[False, True, True], kind="stable")
        size, rate, alike = block["size"].to_numpy(), block["rate"].to_numpy(), block["alike"].to_numpy()
        copies, over = np.zeros(len(block), np.int64), 0.0
        for i in range(len(block)):
            if size[i] > 0:
                want = rate[i] * size[i] * alike[i] + over
                copies[i] = min(max(int(np.floor(want / size[i] + 0.5)), 0), most * int(alike[i]))
                over = want - copies[i] * size[i]
        block["copies"] = copies
        return block[["doc", "code", "source", "size", "total", "target", "alike", "copies"]]
    return run


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per distinct (doc, code, source) of ``docs``: doc (id), code (hash of the text), source, size, total, target, alike (rows), copies (of
    all of them)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("code"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = stored(sized.groupBy("doc", "code", "source", "size").agg(F.count(F.lit(1)).alias("alike")), "sizes")
    histogram = stored(sized.groupBy("source", "size").agg(F.sum("alike").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("total"), F.sum("n").alias("documents"))
    solved = multipliers(histogram, targets(totals.select("source", "total"), share, most, weights), most)
    counts = totals.select(F.col("source").alias("s"), "documents")
    solved = solved.join(counts, F.col("s").eqNullSafe(F.col("source"))).withColumnRenamed("source", "name").drop("s")
    rate = F.when(F.col("free"), _rate(most)).when(F.col("target") > 0, most).otherwise(0.0)
    rows = (sized.join(solved, F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate)
            .withColumn("block", F.pmod(F.xxhash64("doc", "code", F.lit(9)), F.ceil(F.col("documents") / BLOCK))))
    return rows.select("doc", "code", "source", "size", "total", "target", "alike", "rate", "block").groupBy("source", "block").applyInPandas(
        _copies(int(most)), "doc long, code long, source string, size long, total long, target double, alike long, copies long")


#: Copies of the i-th (from 0) of rows alike: even shares that add up, in whole numbers.
_SHARE = "(cast(copies as decimal(19,0)) * (i + 1) div alike) - (cast(copies as decimal(19,0)) * i div alike)"


def op9_mixing(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source"))
    # rows alike become rows again in pieces, so that no task writes all of many
    pieces = out.withColumn("piece", F.explode(F.expr(f"sequence(0L, (alike - 1) div {SPREAD})"))).repartition(F.col("doc"), F.col("code"), F.col("piece"))
    each = pieces.withColumn("i", F.explode(F.expr(f"sequence(piece * {SPREAD}, least(alike, (piece + 1) * {SPREAD}) - 1)")))
    return each.select(F.col("doc").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", (F.expr(_SHARE).cast("long") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows alike in id, text and source share their copies out. Only rows that have others alike
    are numbered: by pieces first, whose counts give each its place."""
    mixed = mix(docs.select("doc_id", "text", "source")).select("doc", "code", F.col("source").alias("of"), "alike", "copies").where("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64("row.text").alias("c"), F.col("row.source").cast("string").alias("s"))
    joined = rows.join(mixed, F.col("d").eqNullSafe(F.col("doc")) & (F.col("c") == F.col("code")) & F.col("s").eqNullSafe(F.col("of")))
    one = joined.where("alike = 1").select("row", F.col("copies").alias("each"))
    many = stored(joined.where("alike > 1").withColumn("id", F.monotonically_increasing_id()).withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(256))), "alike")
    key = ["d", "c", "s"]
    pieces = many.groupBy(*key, "piece").agg(F.count(F.lit(1)).alias("n"))   # at most 256 rows a key
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.withColumn("start", before).select(*[F.col(c).alias(c + "1") for c in key], F.col("piece").alias("piece1"), "start")
    same = F.col("d").eqNullSafe(F.col("d1")) & (F.col("c") == F.col("c1")) & F.col("s").eqNullSafe(F.col("s1")) & (F.col("piece") == F.col("piece1"))
    turn = F.row_number().over(Window.partitionBy(*key, "piece").orderBy("id"))
    placed = many.join(starts, same).withColumn("i", F.col("start") + turn - 1)
    shared = placed.select("row", F.expr(_SHARE).cast("long").alias("each")).where("each > 0")
    return one.union(shared).select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))).select("row.*")
