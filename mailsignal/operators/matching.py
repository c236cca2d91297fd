"""Matching texts against a dictionary that lives in a table.

The active rows of the table are what counts at the time of the query: an upsert or a cleared ``is_active`` takes effect at once.

Keywords are found as substrings of the lower-cased text. The table's size is measured first.

* Up to ``AUTOMATON_BYTES`` it is sent to the tasks as one Aho-Corasick automaton, which reads each text once for all keywords.
* A larger one is joined: keywords by their heads, the first four to eight bytes (as many as the shortest has), texts by the places where such bytes
  stand (known to the tasks from a bit set of ``2 ** HEAD_BITS`` bits, a fixed size), each with as many bytes behind it as the longest keyword
  has; the join keeps places that go on like the keyword. Keywords under four bytes stay with automata, in groups within the limit.

URL patterns are regular expressions: groups of ``PATTERNS`` become literals of one expression each, one scan a group.

Null texts have no hits, an empty keyword is in every text, a null keyword in none; a null flag counts as active; a text is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.operators.dictionary import url_pattern_hits
from mailsignal.session import ship_package

AUTOMATON_BYTES = 8 << 20
_ENTRY_BYTES = 64          # what a keyword costs beside its letters
HEAD, LONG_HEAD, HEAD_BITS = 4, 8, 24
_SPREAD = (1640531527, 1540483477)   # odd and under 2 ** 31: products fit a signed long
PATTERNS = 200
FLUSH = 1 << 16            # rows held before they are sent on


def active(table: DataFrame) -> DataFrame:
    """Rows whose flag is set or null."""
    return table.where(F.coalesce("is_active", F.lit(True)))


def _automaton(words: list[str]):
    import ahocorasick
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            out.add_word(w, i)
    if len(out):
        out.make_automaton()
    return out


def _found(sent):
    """(id, low) -> (id, position of the keyword in the list), once each."""
    def run(batches):
        words = sent.value
        automaton, empty = _automaton(words), [i for i, w in enumerate(words) if not w]
        for batch in batches:
            ids, hits = [], []
            for row, text in enumerate(batch.column(1)):
                low = text.as_py()
                if low is None:
                    continue
                seen = {i for _, i in automaton.iter(low)} if len(automaton) else set()
                ids += [row] * (len(seen) + len(empty))
                hits += [*seen, *empty]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(hits, pa.int64())], names=["id", "entry"])
    return run


def _by_automaton(texts: DataFrame, words: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(words)
    names = texts.sparkSession.createDataFrame(list(enumerate(words)), "entry long, keyword string")   # within the same limit
    return texts.mapInArrow(_found(sent), "id long, entry long").join(F.broadcast(names), "entry").select("id", "keyword")


def _fours(b: np.ndarray, n: int, first: int) -> np.ndarray:
    """The four bytes from ``first`` on, behind each of the first n places, as one number."""
    part = [b[first + i:first + i + n] for i in range(HEAD)]
    return (part[0] << np.uint32(24)) | (part[1] << np.uint32(16)) | (part[2] << np.uint32(8)) | part[3]


def _heads_in(sent, head: int, width: int):
    """(id, low) -> (id, code, window): distinct places of a text where a head of the bit set stands, with ``width`` bytes from there."""
    def run(batches):
        bits = sent.value
        for batch in batches:
            ids, codes, windows = [], [], []

            def pack():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(codes, pa.int64()), pa.array(windows, pa.binary())],  # noqa: B023
                                                  names=["id", "code", "window"])
            for row, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                if len(raw) < head:
                    continue
                b = np.frombuffer(raw, np.uint8).astype(np.uint32)
                n = len(b) - head + 1
                one, two = _fours(b, n, 0), _fours(b, n, head - HEAD)
                at = (one * np.uint32(_SPREAD[0]) + two * np.uint32(_SPREAD[1])) >> np.uint32(32 - HEAD_BITS)   # modulo 2 ** 32
                hit = np.flatnonzero((bits[at >> np.uint32(6)] >> (at & np.uint32(63)).astype(np.uint64)) & np.uint64(1))
                code = ((one[hit].astype(np.uint64) << np.uint64(32)) | two[hit]).view(np.int64)
                for window, c in {raw[i:i + width]: int(c) for i, c in zip(hit.tolist(), code)}.items():
                    ids.append(row)
                    codes.append(c)
                    windows.append(window)
                    if len(ids) == FLUSH:
                        yield pack()
                        ids, codes, windows = [], [], []
            if ids:
                yield pack()
    return run


def _by_join(texts: DataFrame, keywords: DataFrame, head: int, width: int) -> DataFrame:
    """``keywords`` (keyword) of at least ``head`` bytes, four to eight."""
    raw = F.col("keyword").cast("binary")
    four = lambda first: F.conv(F.hex(F.substring(raw, first + 1, HEAD)), 16, 10).cast("long")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    coded = keywords.select("keyword", four(0).alias("one"), four(head - HEAD).alias("two"))
    at = F.shiftright(low(low(F.col("one") * F.lit(_SPREAD[0])) + low(F.col("two") * F.lit(_SPREAD[1]))), 32 - HEAD_BITS)
    cells = coded.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word"))
    got = cells.toArrow()   # at most 2 ** HEAD_BITS / 64 rows
    bits = np.zeros(1 << (HEAD_BITS - 6), np.uint64)
    bits[got["cell"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    places = texts.mapInArrow(_heads_in(texts.sparkSession.sparkContext.broadcast(bits), head, width), "id long, code long, window binary")
    goes_on = F.substring("window", F.lit(1), F.octet_length("keyword")) == F.col("keyword").cast("binary")
    coded = coded.select("keyword", F.shiftleft("one", 32).bitwiseOR(F.col("two")).alias("code"))
    return places.join(coded, "code").where(goes_on).select("id", "keyword").distinct()


def keyword_hits(mails: DataFrame, table: DataFrame, text_col: str = "text", id_col: str = "email_id", limit: int | None = None) -> DataFrame:
    """L4: one row per (mail, active keyword of the table found as a substring of the lower-cased text), with category and weight.
    ``limit``: bytes up to which the dictionary travels as an automaton (``AUTOMATON_BYTES``)."""
    ship_package(mails.sparkSession)
    limit = AUTOMATON_BYTES if limit is None else limit
    rows = active(table).where("keyword is not null").select("keyword", "category", "weight").checkpoint(eager=True)
    texts = mails.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("low"))
    size = F.octet_length("keyword")
    words = rows.select("keyword").distinct()
    of = words.agg(F.coalesce(F.sum(size + _ENTRY_BYTES), F.lit(0)).alias("all"), F.coalesce(F.max(size), F.lit(0)).alias("longest"),
                   F.min(F.when(size >= HEAD, size)).alias("shortest")).first()   # one row
    if of["all"] <= limit:
        found = _by_automaton(texts, [r["keyword"] for r in words.collect()])
    else:
        found = _by_join(texts, words.where(size >= HEAD), min(LONG_HEAD, of["shortest"] or HEAD), of["longest"])
        group, held = [], 0
        for r in words.where(size < HEAD).toLocalIterator():
            group.append(r["keyword"])
            held += _ENTRY_BYTES
            if held >= limit:
                found, group, held = found.union(_by_automaton(texts, group)), [], 0
        if group:
            found = found.union(_by_automaton(texts, group))
    return found.join(rows, "keyword").select(F.col("id").alias("email_id"), "keyword", "category", "weight")


def pattern_hits(urls: DataFrame, table: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per (URL, active pattern of the table whose regular expression finds a match in it)."""
    out, group = None, []

    def scanned(entries):
        hits = url_pattern_hits(urls, entries, url_col)
        return hits if out is None else out.union(hits)
    for r in active(table).where("pattern is not null").orderBy("pattern").toLocalIterator():
        group.append((r["pattern"], r["pattern_type"], r["weight"], True))
        if len(group) == PATTERNS:
            out, group = scanned(group), []
    return scanned(group) if group or out is None else out
