"""An FM-index over a sequence of word ids: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector with constant-time rank: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The ones before position i."""
        word = i >> 6
        below = (U64(1) << (i & 63).astype(np.uint64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & U64(1)).astype(bool)


class WaveletMatrix:
    """rank and access over a sequence of small integers, a bit vector a level."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before position i."""
        start = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            low, high = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + low, start - low)
            i = np.where(one, zeros + high, i - high)
        return i - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, how often it stands before i)."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros):
            one = bits[i]
            low, high = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + low, start - low)
            i = np.where(one, zeros + high, i - high)
            symbol = symbol * 2 + one
        return symbol, i - start


def suffix_array(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The order of all suffixes by prefix doubling.  Where `cut`, a suffix counts as one unique symbol, ordered by place."""
    n = len(values)
    key = values.astype(np.int64)
    key[cut] = int(values.max(initial=0)) + 1 + np.arange(int(cut.sum()))
    order = np.argsort(key, kind="stable")
    width = 1
    while True:
        same = key[order[1:]] == key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(~same)])
        if not same.any():
            return order
        next_ = np.zeros(n, dtype=np.int64)
        next_[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + next_
        order = np.argsort(key, kind="stable")
        width *= 2


class FMIndex:
    """Counts and finds phrases of symbols 2 and up; 1 parts runs, and no phrase holds it.

    Separators are unique in the suffix order.  The start of each run is sampled, besides every
    `sample`-th place, so walking back to a sampled place never passes a separator.
    """

    def __init__(self, values: np.ndarray, sample: int = 16):
        values = np.concatenate([[1], values, [1]]).astype(np.int64)
        cut = values == 1
        order = suffix_array(values, cut)
        before = values[order - 1]  # of place 0 the last: a separator, never walked to
        self.n = len(values)
        # Separators sort after all others, so ids are counted from 2 and separators last.
        counts = np.bincount(values, minlength=int(values.max()) + 1)
        self.first = np.zeros(len(counts) + 1, dtype=np.int64)
        self.first[2:] = np.concatenate([[0], np.cumsum(counts[2:])])
        self.first[1] = len(values) - counts[1]
        self.tree = WaveletMatrix(before)
        sampled = (order % sample == 0) | cut[order - 1] | cut[order]
        self.sampled, self.places = Bits(sampled), order[sampled]
        self.top = len(counts) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `phrases` (left-aligned) at once: the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back].astype(np.int64)
            known = symbol <= self.top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.first[symbol] + self.tree.rank(symbol, low[live]), self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places (in the values given) of suffixes by their rows, walking back to sampled ones."""
        out, at, moved = np.zeros(len(rows), dtype=np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.places[self.sampled.rank(at[done])] + moved
            left, at = left[~done], at[~done]
            if len(left):
                symbol, rank = self.tree.step(at)
                at, moved = self.first[symbol] + rank, moved + 1
        return out - 1
