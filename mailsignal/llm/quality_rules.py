"""Quality rules with suffix-array repetition: which documents are too repetitive or too short.

Every whole text is scanned in byte slices (``textscan``), one row in and one row out, no shuffle.
Beside four plain counts, the verdict comes from a suffix array over the words of each text:

1. A text in which no ``min_repeat`` words occur twice has no such repeat and needs no sorting.
2. The suffixes of the others are ranked by prefix doubling (rank of the first m words, then of the
   first 2m, ...) until every group is a single suffix: the suffix array, in order of word hashes.
3. The longest common prefix of neighbours in the array gives the LCP intervals; the deepest interval
   around a suffix is the longest repeat that starts there, a maximal repeated substring.
4. Their spans are united. A text fails when they cover more than ``max_covered`` of its words or
   when one of them is longer than ``max_longest`` words.

Word and line equality is 64-bit hash equality within one text. Null text counts as empty; an empty
text fails the base rule. Texts are judged whole, at any length; an empty table gives no rows. Repeated rows are judged one by one. Extra columns are left out of
``measure`` and kept by ``keep_good``; their names never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.llm.textscan import SPACE, gram_hashes, mix, slices, span_hashes, within, word_spans
from mailsignal.session import ship_package

MIN_REPEAT = 12
MAX_COVERED = 0.3
MAX_LONGEST = 150
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense rank of each key and the size of its group."""
    _, rank, size = np.unique(key, return_inverse=True, return_counts=True)
    return rank, size[rank]


def _salted(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def repeated(words: np.ndarray, text: np.ndarray, word_offs: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k words occur at least twice in their text, with the rank of those words."""
    fit = np.flatnonzero(within(word_offs, k))
    if not len(fit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, size = _groups(_salted(gram_hashes(words, k)[fit], text[fit]))
    again = size > 1
    return fit[again], rank[again]


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Flags of the positions inside the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_repeats(words: np.ndarray, text: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest repeat at every position where it has at least k words, from the
    suffix array of the texts in which some k words occur twice."""
    hit = np.zeros(len(word_offs) - 1, bool)
    hit[text[repeated(words, text, word_offs, k)[0]]] = True
    pos = np.flatnonzero(hit[text]) if hit.any() else np.zeros(0, np.int64)
    m = len(pos)
    if not m:
        return pos, pos
    left = word_offs[1:][text[pos]] - pos  # words from here to the end of the text
    rank, _ = _groups(_salted(words[pos], text[pos]))
    levels = [rank.astype(np.int32)]
    while int(levels[-1].max()) + 1 < m:  # until every suffix stands alone
        step = 1 << (len(levels) - 1)
        rank = levels[-1].astype(np.int64)
        open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)
        nxt = open_[left[open_] > step]
        refined = rank * (m + 1)
        refined[nxt] += rank[nxt + step] + 1  # a text's words lie side by side in pos
        levels.append(np.unique(refined, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    lcp = np.zeros(m - 1, np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + lcp, m - 1), np.minimum(b + lcp, m - 1)
        inside = (left[a] > lcp) & (left[b] > lcp)
        lcp += np.where(inside & (levels[i][x] == levels[i][y]), 1 << i, 0)
    length = np.zeros(m, np.int64)  # the deeper of the two intervals a suffix borders on
    length[a] = lcp
    length[b] = np.maximum(length[b], lcp)
    far = length >= k
    return pos[far], length[far]


def text_counts(buf: np.ndarray, offs: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    texts = len(offs) - 1
    starts, ends, word_offs = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends)
    text = np.repeat(np.arange(texts), np.diff(word_offs))
    out = {"n_words": np.diff(word_offs), "word_chars": _per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80), offs),
           "n_symbols": _per_text(_SYMBOL[buf], offs)}
    cuts = np.zeros(len(buf) + 1, bool)
    cuts[offs] = True
    cuts[1:] |= np.append(buf, 0)[:-1] == 10
    line = np.flatnonzero(cuts[:-1])
    line_end = np.append(line[1:], len(buf))
    line_end = line_end - (buf[np.maximum(line_end - 1, 0)] == 10) if len(line) else line_end
    used = np.searchsorted(starts, line_end) > np.searchsorted(starts, line)
    line, line_end = line[used], line_end[used]
    owner = np.searchsorted(offs, line, side="right") - 1
    _, first = np.unique(_salted(span_hashes(buf, line, line_end), owner), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)
    at, _ = repeated(words, text, word_offs, 3)
    out["n_repeat_words"] = _per_text(covered(at, 3, len(words)), word_offs)
    at, length = longest_repeats(words, text, word_offs, min_repeat)
    out["covered_words"] = _per_text(covered(at, length, len(words)), word_offs)
    out["longest_repeat"] = np.zeros(texts, np.int64)
    np.maximum.at(out["longest_repeat"], text[at], length)
    return out


def measure(docs: DataFrame, id_cols: list[str], min_repeat: int = MIN_REPEAT, text_col: str = "text") -> DataFrame:
    """``id_cols`` and the counts of each row's whole text."""
    ship_package(docs.sparkSession)
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(id_cols)], F.col(text_col).alias("t"))
    keys = [f"k{i}" for i in range(len(id_cols))]

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(len(keys))):
                counts = text_counts(buf, offs, min_repeat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(keys))]
                    + [pa.array(counts[c].astype(np.int64)) for c in _COUNTS], names=[*keys, *_COUNTS])

    schema = ", ".join([*(f"{k} {taken.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} bigint" for c in _COUNTS)])
    out = taken.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, id_cols)], *_COUNTS)


def verdict(max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST):
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return base, ~base & ~bad


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    base, kept = verdict()
    out = measure(docs, ["doc_id"]).withColumns({"base_failed": base, "kept": kept})
    return out.drop("covered_words", "longest_repeat")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are: the whole row rides along as one key."""
    _, kept = verdict()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return measure(row, ["row"]).where(kept).select("row.*")
