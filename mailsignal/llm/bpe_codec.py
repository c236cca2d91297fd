"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a run of texts that are not known yet are inserted into a trie, as sorted order: the path
from the root to the present word lies on a stack, and the next word keeps the part it shares with it. The
traversal is depth first and carries down the last-token state of each prefix (``bpe``), so
the encoding of a shared prefix is computed once; a word's tokens are read off the stack backwards.
Known words are kept in a bounded table per worker. Words come from ``pretokens``.

One row in, one row out, no shuffle. Null text counts as empty (no tokens, empty text back). Special
strings inside a text become their token, the library's default. A text is encoded whole, at any length; an empty table
gives no rows. Extra columns ride along in ``encode``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsignal.llm import bpe, pretokens
from mailsignal.llm.textscan import slices
from mailsignal.session import ship_package

KNOWN_WORDS = 150_000
RUN_BYTES = 2 << 20


def encode_words(merges: bpe.Merges, words: list[bytes]) -> dict[bytes, list[int]]:
    """Token ids of distinct words, by one depth-first walk over their trie."""
    out: dict[bytes, list[int]] = {}
    lasts, before = [-1], b""
    for word in sorted(words):
        if word in merges.special:
            out[word] = [merges.special[word]]
            continue
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del lasts[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            lasts.append(merges.last(word, end, lasts))
        ids, end = [], len(word)
        while end:
            ids.append(lasts[end])
            end -= len(merges.bytes[lasts[end]])
        ids.reverse()
        out[word], before = ids, word
    return out


class Codec:
    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        self.merges, self.known_words, self.scanner = bpe.load(path), known_words, pretokens.Scanner()
        self.known: dict[bytes, list[int]] = {}

    def distinct(self, buf, offs):
        """Ids of each distinct word, the number of each word's distinct one, word offsets of the texts."""
        starts, ends, first, inverse, word_offs = pretokens.words(self.scanner, buf, offs, list(self.merges.special))
        data = buf.tobytes()
        words = [data[a:e] for a, e in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > self.known_words:
            self.known.clear()
        self.known.update(encode_words(self.merges, [w for w in words if w not in self.known]))
        return [self.known[w] for w in words], inverse, word_offs

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.merges.bytes[i] for i in ids])


def _digest_rows(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                ids, inverse, word_offs = codec.distinct(buf, offs)
                written = np.empty(len(ids), object)
                written[:] = [(",".join(map(str, x)) + ",").encode() for x in ids]
                back = np.empty(len(ids), object)
                back[:] = [codec.decode(x) for x in ids]
                size = np.fromiter(map(len, ids), np.int64, len(ids))[inverse]
                total = np.concatenate(([0], np.cumsum(size)))
                coded, decoded = [], []
                for a, e in zip(word_offs[:-1].tolist(), word_offs[1:].tolist()):
                    one = inverse[a:e]
                    coded.append(hashlib.sha256(b"".join(written[one].tolist())[:-1]).hexdigest())
                    text = b"".join(back[one].tolist()).decode("utf-8", errors="replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(total[word_offs[1:]] - total[word_offs[:-1]]),
                     pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encode_rows(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(1), RUN_BYTES):
                ids, inverse, word_offs = codec.distinct(buf, offs)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
                at = np.concatenate(([0], np.cumsum(size)))
                each = size[inverse]
                total = np.concatenate(([0], np.cumsum(each)))
                # position in flat of every token: the start of its word's ids, and on
                tokens = flat[np.repeat(at[:-1][inverse] - total[:-1], each) + np.arange(total[-1])] if len(inverse) else flat
                lists = pa.ListArray.from_arrays(pa.array(total[word_offs].astype(np.int32)), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["row", "ids"])
    return run


def _decode_rows(path: str):
    def run(batches):
        merges = bpe.load(path)
        for batch in batches:
            ids = batch.column(1)
            text = [None if not x.is_valid else b"".join([merges.bytes[i] for i in x.as_py()]).decode("utf-8", errors="replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["row", "text"])
    return run


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``row`` (struct of the columns but the text) and ``ids`` (token ids of the whole text)."""
    ship_package(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    taken = docs.select(row, F.col(text_col).alias("t"))
    return taken.mapInArrow(_encode_rows(tokenizer), T.StructType([taken.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``row`` and the ``text`` of its ``ids``; null ids give a null text."""
    ship_package(encoded.sparkSession)
    taken = encoded.select("row", "ids")
    return taken.mapInArrow(_decode_rows(tokenizer), T.StructType([taken.schema["row"], T.StructField("text", T.StringType())]))


def op6_bpe_codec(docs: DataFrame, tokenizer: str) -> DataFrame:
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _digest_rows(tokenizer), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", "doc_id")


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``docs`` but the text, and ``ids``."""
    return encode(docs, tokenizer).select("row.*", "ids")
