"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``, by checkpointed dynamic programming.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then text). A row's first fault is
``blank`` (no word), ``duplicate`` (role and text were there before) or ``truncated`` (the last character that is not white space is
none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and duplicate rows), Insert an empty turn 3; a
truncated row that stays costs 3 more. Of the cheapest edit strings the least in ASCII order (D, I, K, R) is taken.

The state after some rows is what was written last: nothing, s, u or a. The cost to finish from each state is a vector of four, and a row
turns the vector after it into the one before it.

1. Rows get a number that runs on within a conversation (range partitions, no window), faults come from aggregates, and
   segments of at most about the square root of the longest conversation hold one small code a row.
2. A segment is a min-plus matrix of 4 x 4. Of each conversation's segments (their number is bounded by that square root) the vectors behind
   them are worked out backward: the only vectors kept, the checkpoints.
3. A segment walks forward from each state it can be entered in. It keeps vectors at checkpoints, again the square root of its
   rows apart, recomputes one block of vectors at a time and takes the least letter whose cost is tight.
4. A conversation's entry states are chained from segment to segment, and edits go back to the rows by row number.

So a conversation of any length is spread over many tasks; one task holds one segment, or one small record of each segment. Texts are
stored once and move once, to their edits. The digest of a conversation is one SHA-256 and so reads its lines in one
task, streamed from a sorted shuffle, never held.

A null conversation id is a conversation of its own; empty tables give empty results; a text is one value of a row, at any length;
repeated rows are rows of their own (and duplicates); null roles and texts are read as one blank; extra columns never matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.llm.graph import stored
from mailsignal.session import ship_package

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEAST_SEGMENT = 1024
BLANKS = " \t\n\x0b\f\r"
INITIALS = "sua"
FINE, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 60  # above any cost
START, S, U, A = range(4)
AT_END = (0, NEVER, NEVER, 0)
_NEXT = {START: U, S: U, U: A, A: U}  # the state after a user or assistant turn, which is all that can come
_KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
_ROLE = {U: "user", A: "assistant"}


# -- one row: codes are 4 * fault + initial (3 where it is none of s, u, a) ------------------------------

def _row(code: int, after: tuple) -> tuple:
    """The vector at a row (before edits of it, insertions not yet considered) from the one behind it."""
    v0, v1, v2, v3 = after
    w0, w1, w2, w3 = DELETE + v0, DELETE + v1, DELETE + v2, DELETE + v3
    fault, role = code >> 2, code & 3
    if fault != BLANK and fault != DUPLICATE:
        stay = TRUNCATED if fault == CUT else 0
        user = stay + v2 + (0 if role == 1 else REROLE)
        assistant = stay + v3 + (0 if role == 2 else REROLE)
        w0, w1, w2, w3 = min(w0, user), min(w1, user), min(w2, assistant), min(w3, user)
        if role == 0:
            w0 = min(w0, stay + v1)
    return w0, w1, w2, w3


def _inserted(v: tuple) -> tuple:
    """The vector when empty turns may come first."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


def _backward(codes: bytes, end: tuple) -> tuple:
    for code in reversed(codes):
        end = _inserted(_row(code, end))
    return end


def _memo(f):
    """Short conversations look alike: results for short code strings are kept, a bounded number of them."""
    kept = lru_cache(1 << 14)(f)
    return lambda codes, *rest: kept(codes, *rest) if len(codes) <= 32 else f(codes, *rest)


@_memo
def matrix(codes: bytes) -> list[int]:
    """Row by row: the cost from each state before the segment to each state behind it."""
    columns = [_backward(codes, tuple(0 if s == t else NEVER for s in range(4))) for t in range(4)]
    return [min(columns[t][s], NEVER) for s in range(4) for t in range(4)]


def through(m: list[int], end: tuple) -> tuple:
    return tuple(min(min(m[4 * s + t] + end[t] for t in range(4)), NEVER) for s in range(4))


@_memo
def walk(codes: bytes, end: tuple, state: int, last: bool) -> tuple[int, str]:
    """(state behind the segment, edits) of the ASCII-least cheapest edits from ``state``; ``end`` is the vector behind the segment.
    Insertions after the last row of a segment belong to the next one, but for the ``last`` segment."""
    n = len(codes)
    step = max(1, int(n ** 0.5))
    marks = {}
    v = _inserted(end) if last else end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[(i // step)] = v  # behind the last row of its block
        v = _inserted(_row(codes[i], v))
    out = []
    for first in range(0, n, step):
        block = codes[first:first + step]
        behind = [marks[first // step]]
        for code in reversed(block):
            behind.append(_inserted(_row(code, behind[-1])))
        behind.reverse()  # behind[i]: at row i of the block; behind[i + 1]: behind it
        for i, code in enumerate(block):
            after, fault, role = behind[i + 1], code >> 2, code & 3
            stays = fault != BLANK and fault != DUPLICATE
            more = TRUNCATED if fault == CUT else 0
            cost = behind[i][state]
            while True:
                if cost == DELETE + after[state]:
                    out.append("D")
                    break
                if cost == INSERT + behind[i][_NEXT[state]]:
                    out.append("I")
                    state = _NEXT[state]
                    cost -= INSERT
                    continue
                kept = _KEPT.get((state, INITIALS[role])) if stays and role < 3 else None
                if kept is not None and cost == more + after[kept]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
    if last:
        while state not in (START, A):
            out.append("I")
            state = _NEXT[state]
    return state, "".join(out)


# -- Spark ------------------------------------------------------------------------------------------------

def _numbered(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, same (digest of role and text), blank, cut and ``at``: a number that grows along each conversation."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    t = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                     F.monotonically_increasing_id().alias("salt"))  # rows alike in all else may lie in several parts
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    tail = F.rtrim("text", F.lit(BLANKS))
    return stored(t.select("conv", "turn", "role", "text", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("same"),
                           (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                           F.monotonically_increasing_id().alias("at")), "turns")


def _segments(rows: DataFrame) -> DataFrame:
    """conv, first (number of the first row: the segment's key), codes."""
    longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    length = max(LEAST_SEGMENT, int(longest ** 0.5) + 1)
    firsts = rows.where("not blank").groupBy("conv", "same").agg(F.min("at").alias("first_at"))
    initial = F.coalesce(F.try_element_at(F.create_map(*[x for i, c in enumerate(INITIALS) for x in (F.lit(c), F.lit(i))]), F.left("role", F.lit(1))), F.lit(3))
    slim = rows.select("conv", "at", initial.alias("initial"), "blank", "cut").join(firsts.select("first_at"), F.col("at") == F.col("first_at"), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first_at").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    coded = slim.select("conv", "at", F.expr(f"at div {length}").alias("segment"), (4 * fault + F.col("initial")).cast("tinyint").alias("code"))
    return stored(coded.groupBy("conv", "segment").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
                  .select("conv", "first", F.transform("rows", lambda x: x["code"]).alias("codes")), "segments")


def _legal(before: int, now: int) -> bool:
    return (before, now) in ((0, 1), (1, 2), (2, 1))


def _summaries(batches):
    for batch in batches:
        out = []
        for codes in batch.column(2):  # one segment at a time
            raw = bytes(codes.as_py())
            faults = [0, 0, 0, 0]
            for c in raw:
                faults[c >> 2] += 1
            illegal = sum(not _legal(a & 3, b & 3) for a, b in zip(raw, raw[1:]))
            out.append((matrix(raw), raw[0] & 3, raw[-1] & 3, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal))
        kinds = [pa.list_(pa.int64()), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                                         names=["conv", "first", "matrix", "initial", "final", "blank", "duplicate", "truncated", "illegal"])


def _checkpoints(batches):
    """A conversation's segments in order -> its cost and counts, and the vector behind each segment."""
    for batch in batches:
        out = []
        for segments in batch.column(1).to_pylist():
            end, vectors = AT_END, []
            end = _inserted(end)
            for s in reversed(segments):
                vectors.append({"first": s["first"], "end": list(end), "opens": False, "last": s is segments[-1]})
                end = through(s["matrix"], end)
            vectors[-1]["opens"] = True
            across = sum(not _legal(a["final"], b["initial"]) for a, b in zip(segments, segments[1:]))
            out.append((end[START], *(sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated")), sum(s["illegal"] for s in segments) + across, vectors))
        kinds = [*[pa.int64()] * 5, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.list_(pa.int64())), ("opens", pa.bool_()), ("last", pa.bool_())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                                         names=["conv", "cost", "blank", "duplicate", "truncated", "illegal", "vectors"])


def _walks(batches):
    for batch in batches:
        exits, parts = [], []
        for codes, end, opens, last in zip(batch.column(2), *(batch.column(i).to_pylist() for i in range(3, 6))):
            # relative costs are all a walk looks at: equal ones share what was kept
            least = min(end)
            end = tuple(min(x - least, NEVER) for x in end)
            done = [walk(bytes(codes.as_py()), end, s, last) if s == START or not opens else (START, "") for s in range(4)]
            exits.append([d[0] for d in done])
            parts.append([d[1] for d in done])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exits, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.string()))], names=["conv", "first", "exits", "parts"])


def _chained(batches):
    """A conversation's segments in order -> audit, and the state in which each segment is entered."""
    for batch in batches:
        audits, entries = [], []
        for segments in batch.column(1).to_pylist():
            state, audit, where = START, [], []
            for s in segments:
                where.append({"first": s["first"], "state": state, "part": s["parts"][state]})
                audit.append(s["parts"][state])
                state = s["exits"][state]
            audits.append("".join(audit))
            entries.append(where)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("state", pa.int32()), ("part", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audits, pa.string()), pa.array(entries, kind)], names=["conv", "audit", "entries"])


def _row_edits(batches):
    """One record a row: its number, edit, new role (null: as it was), the roles of empty turns before and (after the last row) behind it."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in batches:
        out = []
        for first, state, part, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            codes, before, at = codes.as_py(), [], 0
            for letter in part:
                if letter == "I":
                    state = _NEXT[state]
                    before.append(_ROLE[state])
                    continue
                role = None
                if letter == "K":
                    state = _KEPT[state, INITIALS[codes[at] & 3]]
                elif letter == "R":
                    state = _NEXT[state]
                    role = _ROLE[state]
                out.append((first + at, letter, role, before, []))
                before, at = [], at + 1
            if before:
                out[-1] = (*out[-1][:4], before)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["edited", "edit", "new_role", "before", "behind"])


def _in_order(rows: DataFrame, *fields: str) -> DataFrame:
    """conv and its segments by number; their number is bounded by the square root of the longest conversation."""
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", *fields))).alias("segments"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, rows) of (conv_id, turn, role, text). Report: one row a conversation with its fault counts, cost and audit.
    Rows: the repaired turns with conv, at (their order), place (order within ``at``), role, text and edit (K, R or I)."""
    spark = turns.sparkSession
    ship_package(spark)
    rows = _numbered(turns)
    segments = _segments(rows)
    summary = segments.mapInArrow(_summaries, "conv long, first long, matrix array<long>, initial long, final long, blank long, duplicate long, truncated long, illegal long")
    vector = "struct<first:long,end:array<long>,opens:boolean,last:boolean>"
    costs = stored(_in_order(summary, "matrix", "initial", "final", "blank", "duplicate", "truncated", "illegal").mapInArrow(
        _checkpoints, f"conv long, cost long, blank long, duplicate long, truncated long, illegal long, vectors array<{vector}>"), "checkpoints")
    ends = costs.select(F.explode("vectors").alias("v")).select("v.*")
    walks = segments.join(ends, "first").select("conv", "first", "codes", "end", "opens", "last").mapInArrow(_walks, "conv long, first long, exits array<int>, parts array<string>")
    chained = stored(_in_order(walks, "exits", "parts").mapInArrow(_chained, "conv long, audit string, entries array<struct<first:long,state:int,part:string>>"), "audits")
    entered = chained.select(F.explode("entries").alias("e")).select("e.*").join(segments.select("first", "codes"), "first")
    edits = entered.select("first", "state", "part", "codes").mapInArrow(_row_edits, "edited long, edit string, new_role string, before array<string>, behind array<string>")
    said = rows.select("conv", "at", "role", "text").join(edits, F.col("at") == F.col("edited"))
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text", "edit")))
    own = F.coalesce(own, F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    lines = said.select("conv", "at", F.posexplode(F.concat(empty("before"), own, empty("behind")))).select("conv", "at", F.col("pos").alias("place"), "col.*")
    turn = rows.select("conv", "turn").distinct().groupBy("conv").agg(F.min("turn").alias("x"), F.max("turn").alias("y"), F.count("turn").alias("c"))
    gap = F.expr("try_cast(cast(y as decimal(20,0)) - cast(x as decimal(20,0)) + 1 - c as long)")
    report = (costs.drop("vectors").join(chained.select(F.col("conv").alias("v"), "audit"), F.col("conv").eqNullSafe(F.col("v"))).drop("v")
              .join(turn.select(F.col("conv").alias("v"), F.coalesce(gap, F.lit(0)).alias("gaps")), F.col("conv").eqNullSafe(F.col("v"))).drop("v"))
    return report, lines


def _digests(batches):
    now, sha, out = None, None, []
    names = ["conv", "repaired_sha256"]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=names)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if sha is None or conv != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if out:
            yield pack(out)
            out = []
    if sha is not None:
        yield pack([(now, sha.hexdigest())])


def digests(lines: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the ``role:text`` lines joined by line ends."""
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "role", "text")
    return ordered.mapInArrow(_digests, "conv long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by the CRC-32 of ``conv_id:turn``: a row is dropped (0), emptied (1), loses ``.!?`` (2), comes twice (3) or is the user's (4)."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return c.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_structure_repair(conversations: DataFrame) -> DataFrame:
    report, lines = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    sha = digests(lines).select(F.col("conv").alias("v"), "repaired_sha256")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(sha, F.col("conv_id").eqNullSafe(F.col("v")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
