"""Vectorised word splitting and hashing over Arrow string buffers.

A batch of texts is one byte buffer with offsets.  Words are found with table
look-ups over the whole buffer and hashed with prefix sums of a keyed
polynomial, so there is no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random odd 64-bit key for each byte value.
_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table that is true for the byte values in the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after folding A-Z).
NON_SPACE = ~byte_class([(0x09, 0x0D), (0x20, 0x20)])
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` text bytes; a text is never cut."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of a buffer: start, end (byte positions), hash, and the text each belongs to.

    bounds[i]:bounds[i + 1] are the words of text i.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE, fold: bool = True, hashes: bool = True):
        data = FOLD[raw] if fold else raw
        self.data = data
        inside = table[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        if hashes:
            sums = np.empty(len(data) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_KEYS[data] * _powers(_BASE, len(data)), out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_BASE_INV, len(data) + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def word_hash(word: bytes) -> int:
    """The hash that `Words` gives to one word."""
    total = 0
    for k, b in enumerate(word):
        total = (total + int(_KEYS[b]) * pow(_BASE, k, 1 << 64)) % (1 << 64)
    return int(mix(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))[0])


_MULT = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct word shingles, sorted by text, then hash.

    A text of fewer words (but one at least) has its whole sequence as its one shingle.
    """
    n, owner = words.counts, words.text_of()
    h = words.hash
    total = len(h)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = words.bounds[1:][owner] - np.arange(total)  # words from here to the text's end
    acc = np.zeros(total, dtype=np.uint64)
    short = n[owner] < width
    for k in range(width):
        there = left > k
        acc *= _MULT[k % 4]
        if k:
            acc[:-k] += np.where(there[:-k], h[k:] + U64(k + 1), U64(0))
        else:
            acc += h + U64(1)
    value = mix(acc)
    valid = (left >= width) | (short & (left == n[owner]))
    value, owner = value[valid], owner[valid]
    cuts = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], owner[fresh]
