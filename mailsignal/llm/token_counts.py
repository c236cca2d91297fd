"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers replace the tokenizer. The first cuts texts to words (``pretokens``): chunk
maps from start to end states are composed by a parallel prefix scan, so a text of any length is
scanned in chunks side by side. The second reads the bytes of a word: its state stands for the prefix read, and each
transition is annotated with the change of the token count of the encoding (it may be negative: a
byte can complete a merge). Summing the annotations along a word gives its tokens. States are compiled when
first needed, from the last-token rule of ``bpe``, and kept up to ``max_states`` per worker, as are the sums of
words met before; beyond that both start afresh, which changes no result.

One row in, one row out, no shuffle. Null text counts as empty (0 tokens). Special strings inside a text
count as their one token, which is the library's default. An empty table gives no rows. Extra columns never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsignal.llm import bpe, pretokens
from mailsignal.llm.textscan import slices
from mailsignal.session import ship_package

LIMIT = 1024
MAX_STATES = 600_000
RUN_BYTES = 2 << 20


class WordTransducer:
    """Bytes of a word -> number of tokens."""

    def __init__(self, merges: bpe.Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = dict.fromkeys(self.merges.special, 1)
        self.step: dict[int, int] = {}  # (state << 8) | byte -> state
        self.delta: list[int] = [0]  # change of the token count on entering the state
        self.total: list[int] = [0]
        self.last: list[int] = [-1]

    def count(self, word: bytes) -> int:
        tokens = self.known.get(word)
        if tokens is not None:
            return tokens
        if len(self.last) > self.max_states:
            self._clear()
        state, tokens, path = 0, 0, [0]
        for i, byte in enumerate(word):
            nxt = self.step.get(state << 8 | byte)
            if nxt is None:
                nxt = self._compile(state, byte, word, i + 1, path)
            state = nxt
            path.append(state)
            tokens += self.delta[state]
        self.known[word] = tokens
        return tokens

    def _compile(self, state: int, byte: int, word: bytes, end: int, path: list[int]) -> int:
        token = self.merges.last(word, end, _Lasts(self.last, path))
        total = self.total[path[end - len(self.merges.bytes[token])]] + 1
        new = len(self.last)
        self.last.append(token)
        self.total.append(total)
        self.delta.append(total - self.total[state])
        self.step[state << 8 | byte] = new
        return new


class _Lasts:
    """Last token of each prefix, by the states on the way."""

    def __init__(self, last: list[int], path: list[int]):
        self.last, self.path = last, path

    def __getitem__(self, i: int) -> int:
        return self.last[self.path[i]]


def _count_rows(path: str):
    def run(batches):
        merges = bpe.load(path)
        words, scanner = WordTransducer(merges), pretokens.Scanner()
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                starts, ends, first, inverse, word_offs = pretokens.words(scanner, buf, offs, list(merges.special))
                data = buf.tobytes()
                each = np.fromiter((words.count(data[a:e]) for a, e in zip(starts[first].tolist(), ends[first].tolist())), np.int64, len(first))
                total = np.concatenate(([0], np.cumsum(each[inverse])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(total[word_offs[1:]] - total[word_offs[:-1]])],
                    names=["key", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and n_tokens of each whole text, as the tokenizer file at ``tokenizer`` has them."""
    ship_package(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"))
    out = taken.mapInArrow(_count_rows(tokenizer), f"key {taken.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", id_col)


def op5_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    return count_tokens(docs, tokenizer).withColumn("over_limit", F.col("n_tokens") > LIMIT)
