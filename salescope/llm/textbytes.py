"""Vectorised word and n-gram hashing over the byte buffers of Arrow text columns.

Texts are handled in slices of a few megabytes whatever the size of the batch,
so working arrays stay small; one longer text is a slice of its own.  All
hashes are 64-bit, depend on the bytes alone and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: lower-casing of A-Z on bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """Truth table of the bytes in the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a:b + 1] = True
    return out


#: everything but white space [\x20\x09-\x0D]
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text: ASCII letters, digits, all other characters
WORD_BYTES = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain), on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row ranges of a text
    column; nulls are empty texts."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + budget, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of word bytes inside a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span (spans are not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    powers = np.full(int(lens.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = _BYTE[data[np.repeat(starts, lens) + pos]] * powers[pos]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n consecutive words of a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * _BASE + words[at + k] + np.uint64(n))
    return h, at


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of the lower-cased (A-Z) texts of a slice."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, word)
    return hash_spans(low, starts, ends), rows
