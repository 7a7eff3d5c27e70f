"""Benchmark decontamination with an FM-index for each shard of training texts.

A shard is a run of texts that a task holds anyway.  Words that no benchmark
phrase has cannot be part of an occurrence, so a shard's sequence keeps only runs
of benchmark words as long as the shortest phrase, parted by separators.  Each
distinct phrase is searched backward through wavelet ranks, its occurrences are
located by sampled suffix positions, and the spans of each text are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._bytes import ALNUM, Words, buffers, slices
from ._shared import Workspace
from .fm_index import FMIndex

#: Words of benchmark items that are searched for in one pass; a larger benchmark takes several.
BLOCK_WORDS = 2_000_000
SHARD_TEXT = 8 << 20
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


class Phrases:
    """The distinct phrases of some items: windows of `width` words, or a whole shorter item."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        words = Words(*buffers(pa.array([t for _, t in items], pa.large_string())), ALNUM)
        self.vocabulary = np.unique(words.hash)
        ids = np.searchsorted(self.vocabulary, words.hash) + 2
        rows: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[words.bounds[k] : words.bounds[k + 1]].tolist()
            for i in range(max(1, len(own) - width + 1) if own else 0):
                rows.setdefault(tuple(own[i : i + width]), set()).add(item)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.rows = np.zeros((len(rows), width), dtype=np.int32)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = r
        self.items = [sorted(x) for x in rows.values()]
        # The top bits of a hash lead to its place in the sorted vocabulary.
        self.shift = np.uint64(64 - max(8, min(20, (4 * max(1, len(self.vocabulary))).bit_length())))
        self.table = np.searchsorted(self.vocabulary, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """2 and up for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), dtype=np.int32)
        if not len(self.vocabulary):
            return out
        at = self.table[(hashes >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(at < len(self.vocabulary))
        at = at[todo]
        while len(todo):
            have, want = self.vocabulary[at], hashes[todo]
            hit = have == want
            out[todo[hit]] = at[hit] + 2
            more = (have < want) & (at + 1 < len(self.vocabulary))
            todo, at = todo[more], at[more] + 1
        return out


def find(words: list[Words], phrases: Phrases) -> Iterator[list[tuple[int, list[tuple[int, int]], list[str]]]]:
    """For each group of texts: (hit words, merged spans of word positions, items) of each text."""
    ids = [phrases.ids(w.hash) for w in words]
    kept, place, total = [], [], 0
    shortest = int(phrases.lengths.min(initial=1 << 30))
    for own, w in zip(ids, words):
        n = len(own)
        inside = own > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = w.bounds[:-1][w.counts > 0]
        first[starts] = inside[starts]
        begin = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        length = np.flatnonzero(last) + 1 - begin
        long = length >= shortest
        begin, length = begin[long], length[long]
        if len(begin):
            # A run and one separator after it: the separator's place is never part of a phrase.
            gap = np.arange(int(length.sum()) + len(length))
            offset = np.repeat(begin - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1)
            at = gap + offset
            ends = np.cumsum(length + 1) - 1
            value = own[np.minimum(at, n - 1)]
            value[ends] = 1
            kept.append(value)
            place.append(at + total)
        total += n
    hits = np.zeros(total + 1, dtype=np.int64)
    pairs = np.zeros((0, 2), dtype=np.int64)
    if kept and len(phrases.rows):
        index, where = FMIndex(np.concatenate(kept)), np.concatenate(place)
        low, high = index.search(phrases.rows, phrases.lengths)
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        rows = np.arange(int(times.sum())) + np.repeat(low[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        phrase = np.repeat(found, times)
        at = where[index.locate(rows)]
        np.add.at(hits, at, 1)
        np.add.at(hits, at + phrases.lengths[phrase], -1)
        pairs = np.stack([at, phrase], 1)
    hit = np.cumsum(hits[:-1]) > 0
    base = 0
    for w in words:
        out = [(0, [], [])] * (len(w.bounds) - 1)
        own = pairs[(pairs[:, 0] >= base) & (pairs[:, 0] < base + len(w.start))]
        text = np.searchsorted(w.bounds, own[:, 0] - base, side="right") - 1
        for t in np.unique(text):
            a, b = w.bounds[t], w.bounds[t + 1]
            mark = np.concatenate([[False], hit[base + a : base + b], [False]])
            edge = np.flatnonzero(mark[1:] != mark[:-1])
            spans = list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))
            items = sorted({x for p in np.unique(own[text == t, 1]) for x in phrases.items[p] if x is not None})
            out[t] = (sum(q - p + 1 for p, q in spans), spans, items)
        base += len(w.start)
        yield out


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((row[0], row[1] or ""))
        size += len(row[1] or "") // 4 + 1
        if size > BLOCK_WORDS:
            yield Phrases(held, width)
            held, size = [], 0
    if held or not size:
        yield Phrases(held, width)


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(p, q) for p, q in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, into: str = "contamination", remove: bool = False, text_column: str = "text") -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, items (sorted), spans (merged, word positions); a column of that name is replaced.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z folded.  A phrase is `width`
    consecutive words of an item (benchmark: item_id, text), or all words of a shorter
    one.  Every word inside an occurrence is hit.  Null or wordless texts have no words
    and no hits; null or wordless items have no phrase; items of a null id stand in no
    list.  With remove, the bytes of each span, first word to last, are cut out of the
    text.  Rows keep their number, copies included; without rows there are none.  Of the
    benchmark, two blocks of BLOCK_WORDS words are on the driver at most.
    """
    work = Workspace(docs.sparkSession, "decontamination")
    out = docs.drop(into)
    blocks = _blocks(benchmark, width) if benchmark is not None else iter([Phrases([], width)])
    text_at = out.columns.index(text_column)
    schema = T.StructType([*out.schema.fields, T.StructField(into, FOUND)])
    arrow = to_arrow_schema(schema)

    def scan(number: int, shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[pa.RecordBatch, Words]] = []
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for (piece, w), found in zip(held, find([w for _, w in held], shared.value)):
                    counts = w.counts.tolist()
                    rows = [{"n_words": n, "n_hit": hit, "items": items, "spans": spans} for n, (hit, spans, items) in zip(counts, found)]
                    if number:
                        for row, old in zip(rows, piece.column(len(arrow) - 1).to_pylist()):
                            row["items"] = sorted({*row["items"], *old["items"]})
                            row["spans"] = _merged(row["spans"], [(s["first"], s["last"]) for s in old["spans"]])
                            row["n_hit"] = sum(q - p + 1 for p, q in row["spans"])
                    for row in rows:
                        row["spans"] = [{"first": p, "last": q} for p, q in row["spans"]]
                    columns = [piece.column(k) for k in range(len(arrow) - 1)]
                    if last and remove:
                        texts = columns[text_at].to_pylist()
                        for k, row in enumerate(rows):
                            if row["spans"]:
                                raw, cut, base, origin = texts[k].encode(), [], int(w.bounds[k]), int(w.offsets[k])
                                at = 0
                                for s in row["spans"]:
                                    cut.append(raw[at : int(w.start[base + s["first"]]) - origin])
                                    at = int(w.end[base + s["last"]]) - origin
                                texts[k] = b"".join([*cut, raw[at:]]).decode()
                        columns[text_at] = pa.array(texts, arrow.field(text_at).type)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)] + [pa.array(rows, arrow.field(into).type)], schema=arrow)

            for batch in batches:
                for piece in slices(batch, text_column):
                    raw, offsets = buffers(piece.column(text_at))
                    w = Words(raw, offsets, ALNUM)
                    w.offsets = offsets
                    del w.data
                    held.append((piece, w))
                    size += len(raw)
                    if size > SHARD_TEXT:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        return run

    number, block = 0, next(blocks)
    while block is not None:
        following = next(blocks, None)
        held = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(scan(number, held, following is None), schema)
        if following is not None:  # a pass is written before the next block is sent, and its own is given up
            out = work.write(out, f"pass-{number}")
            held.destroy()
            if number:
                work.drop(f"pass-{number - 1}")
        number, block = number + 1, following
    return out
