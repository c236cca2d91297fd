"""Vectorised scanning of Arrow text columns: byte slices, words and rolling word hashes.

A text column arrives as one Arrow batch. ``slices`` walks it in runs of whole texts of about
``SLICE_BYTES`` (a longer text is a run of its own), so numpy temporaries stay small however many
rows Spark puts in a batch. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16
#: Odd multipliers of the multilinear k-gram hash; gram(k) uses the first k of either row.
_MULT = _rng.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(_BASE, _BLOCK)
_INV_LOW = _powers(_INV, _BLOCK)


def _high(base: int, blocks: int) -> np.ndarray:
    return _powers(pow(base, _BLOCK, 1 << 64), blocks)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_utf8()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) byte of each word, and the word offsets of each text."""
    n = len(buf)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~SPACE[buf]
    inside[n] = False
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, finalised with the length."""
    n = len(buf)
    prefix = np.zeros(n + 1, np.uint64)
    blocks = n // _BLOCK + 1
    up, down = _high(_BASE, blocks), _high(_INV, blocks)
    for b in range(0, n, _BLOCK):
        part = _BYTE[buf[b:b + _BLOCK]]
        part *= _LOW[:len(part)]
        part *= up[b // _BLOCK]
        prefix[b + 1:b + 1 + len(part)] = part
    np.add.accumulate(prefix, out=prefix)
    shift = _INV_LOW[starts & (_BLOCK - 1)] * down[starts >> 16]
    return mix((prefix[ends] - prefix[starts]) * shift + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int, row: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (across texts too: the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j:j + n] * _MULT[row, j]
    return mix(out)


def within(word_offs: np.ndarray, k: int) -> np.ndarray:
    """True at each word position where k words starting there lie in one text."""
    total = int(word_offs[-1])
    end = np.repeat(word_offs[1:], np.diff(word_offs))
    return (end - np.arange(total) >= k)[:max(0, total - k + 1)]
