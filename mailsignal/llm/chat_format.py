"""Chat formatting by prefix-target expansion: one training example per assistant turn.

An example is the text of all turns up to an assistant turn; only that turn's words are trainable
(``loss_start`` to ``loss_end``). A turn is written ``<turn ROLE>TEXT</turn>`` and a line end; inside roles and texts ``\\``, ``<``
and ``>`` get a ``\\`` before them, so no text can pose as a marker and ``read_turns`` gets every text back. Turns after
the last reply make one more example without a target, so that nothing of a conversation is lost.

Turns are numbered without a window over a conversation (range partitions and a small table of their offsets). A conversation is cut into
parts of ``PART`` turns, and a task streams the turns up to the end of one part and writes the examples of that part's replies: a
long conversation is many tasks, each holding one prefix, and a short one is read once. Examples repeat their prefix,
which is the method's size: quadratic in the turns of one conversation, linear in the number of conversations.

Null texts and roles count as empty, at any length; a null conversation id is a conversation of its own, null turns come first, and equal
turns are ordered by role and text; repeated rows are turns of their own; an empty table gives no examples. Extra columns never matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored
from mailsignal.session import ship_package

TARGET = "assistant"
FLUSH_CHARS = 1 << 21
PART = 1024
_SPECIAL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>((?:[^\\<>]|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(example: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    out, at = [], 0
    while at < len(example):
        m = _TURN.match(example, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_EXAMPLE = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"


def _examples(part: int):
    """(conv, part, place, turns, role, text) by conv, part and place -> the examples of each part's replies; ``example`` is the place of its last turn."""
    def run(batches):
        names = ["conv_id", "example", "text", "loss_start", "loss_end", "last"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        rows, held = [], 0
        now, parts = None, []

        def pack():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            convs, numbers, places, turns = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):  # texts are taken one at a time
                if (convs[i], numbers[i]) != now:
                    now, parts = (convs[i], numbers[i]), []
                role, place = batch.column(4)[i].as_py(), places[i]
                head, body = f"<turn {escape(role)}>", escape(batch.column(5)[i].as_py())
                parts.append(f"{head}{body}</turn>\n")
                last = place == turns[i] - 1
                if place // part == numbers[i] and (role == TARGET or last):
                    example = "".join(parts)
                    start = len(example) - len(parts[-1]) + len(head)
                    rows.append((convs[i], place, example, start, start + len(body), last) if role == TARGET else (convs[i], place, example, None, None, last))
                    held += len(example)
                if held > FLUSH_CHARS:
                    yield pack()
                    rows, held = [], 0
        if rows:
            yield pack()
    return run


def numbered(turns: DataFrame) -> DataFrame:
    """conv, place (from 0), turns (of the conversation), role, text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    t = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"),
                     F.monotonically_increasing_id().alias("salt"))   # rows alike in all else may lie in several partitions
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    t = stored(t.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")), "turns")
    runs = t.groupBy("conv", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))   # a conversation has one row for each partition it lies in
    mine = Window.partitionBy("conv").orderBy("pid")
    before = F.coalesce(F.sum("n").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("conv").alias("c"), F.col("pid").alias("p"), "first", before.alias("before"), F.sum("n").over(Window.partitionBy("conv")).alias("turns"))
    j = t.join(runs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")))
    return j.select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "turns", "role", "text")


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example (place of its last turn), text, loss_start, loss_end, last (whether it is the conversation's last example)."""
    ship_package(turns.sparkSession)
    t = numbered(turns).withColumn("part", F.explode(F.expr(f"sequence(place div {PART}, (turns - 1) div {PART})")))
    dealt = t.repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
    return dealt.select("conv", "part", "place", "turns", "role", "text").mapInArrow(_examples(PART), _EXAMPLE)


def _read_back(batches):
    """Each example's size and the words under its loss mask; of a conversation's last one also its turns."""
    names = ["conv_id", "example", "chars", "words", "n_turns", "turns_sha256"]
    for batch in batches:
        convs, examples, starts, ends, last = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        chars, words, count, sha = [], [], [], []
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py()
            chars.append(len(text))
            words.append(None if starts[i] is None else unescape(text[starts[i]:ends[i]]))
            turns = read_turns(text) if last[i] else None
            count.append(turns and len(turns))
            sha.append(turns and hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        columns = zip((convs, examples, chars, words, count, sha), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)


def _loss_digests(batches):
    """(conv, words) in order -> loss_chars, loss_sha256; one reply is held at a time."""
    names, kinds = ["conv", "loss_chars", "loss_sha256"], [pa.int64(), pa.int64(), pa.string()]
    now, done = None, []
    for batch in batches:
        convs = batch.column(0).to_pylist()
        for i, conv in enumerate(convs):
            if now is None or now[0] != conv:
                if now:
                    done.append((now[0], now[1], now[2].hexdigest()))
                now = [conv, 0, hashlib.sha256()]
            words = batch.column(1)[i].as_py()
            now[1] += len(words)
            now[2].update(words.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((now[0], now[1], now[2].hexdigest()), kinds)], names=names)


def op7_chat_format(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its examples."""
    spark = conversations.sparkSession
    tricky = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), tricky.alias("text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    read = stored(expand(turns.union(extra)).mapInArrow(_read_back, "conv_id long, example long, chars long, words string, n_turns long, turns_sha256 string"), "examples")
    whole = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"))
    loss = (read.where("words is not null").select(F.col("conv_id").alias("conv"), "example", "words").repartition("conv").sortWithinPartitions("conv", "example")
            .select("conv", "words").mapInArrow(_loss_digests, "conv long, loss_chars long, loss_sha256 string"))
    out = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return out.select("conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).cast("long").alias("loss_chars"),
                      F.coalesce("loss_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("loss_sha256"), "formatted_chars")
