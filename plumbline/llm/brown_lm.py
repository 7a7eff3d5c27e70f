"""Language-model scoring with Brown class-based n-grams.

Words are assigned to classes by exchange clustering.  The HEAD commonest words begin: they
are moved, one at a time, to the class that gains most class-bigram mutual information.  Then
all training words, the head's included, move by the same gain: the counts of the classes on
both sides of each word are summed over the corpus, and each word goes where it gains most.
The gain of a word of more than EXACT training tokens is worked out in full, and such words move
in two halves by turns; that of others to first order (their counts are small beside the
classes').  Steps go on until information hardly grows.  A word's probability mixes class
transitions (trigram, bigram and unigram of classes) times its emission from its class, and
the add-one unigram of words:

    P(w | g1, g2) = (1 - u) (L3 P(g | g1, g2) + L2 P(g | g2) + L1 P(g)) c(w) / n(g) + L0 (c(w) + 1) / (N + V + 1)

g is w's class, g1 and g2 are those of the two known words before it in its own text, or the
end's where the text has begun since.  Words that are not in training are one unknown type
without a class: its probability is u = 1 / (N + V + 1), and it leaves the history as it was.
So a text's score depends on its words and the training texts alone: equal texts score alike.

All counts cover the whole training part.  The corpus is tokenised once into chunks (local
word lists and packed token ids) in the shared folder; word counts and classes are summed by
parts of the hash space and sent back to the chunks.  Only tables of a fixed size (HEAD
squared, and CLASSES cubed counts) come to the driver.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ._bytes import NON_SPACE, Words, buffers, slices, word_hash
from ._shared import Workspace

HEAD, CLASSES, SWEEPS = 1000, 32, 6
#: Exchange over all words ends when information grows by less than this share in a step.
LEAST_GAIN = 0.01
#: Training tokens of a word from which its gains are worked out in full.
EXACT = 256
L3, L2, L1, L0 = 0.45, 0.3, 0.1, 0.15
#: Text bytes of one chunk, and word list entries of one part, about.
CHUNK, PART = 3 << 20, 400_000
END = word_hash(b"\n")  # no word has white space
NO_CLASS = 255

_CHUNKS = "chunk string, doc_ids array<long>, held array<boolean>, bounds binary, tokens binary, end long, words binary, counts binary"
#: Of a chunk, what goes on; `slices` has (part, number of words) of the parts of its word list.
_TEXTS = ("doc_ids", "held", "bounds", "tokens", "end")
_READY = "chunk string, doc_ids array<long>, held array<boolean>, bounds binary, tokens binary, end long, kinds binary, slices binary"
_CLASSED = "part int, words binary, counts binary, kinds binary"
_NEAR = "part int, chunk string, places binary, at binary, times binary"
#: The part of rows that have class bigrams.
TABLE = -1
#: Context cells of a word: the classes before it, those after it, and the word itself after it.
CELLS = 2 * CLASSES + 1


def _u(row, kind):
    return np.frombuffer(row.as_buffer(), kind)


def _packed(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpacked(cell, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(memoryview(cell.as_buffer())), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Row by row, nothing copied."""
    for k in range(batch.num_rows):
        yield {name: column[k] for name, column in zip(batch.schema.names, batch.columns)}


def _chunks(docs: DataFrame, train: Column) -> DataFrame:
    """Rows of _CHUNKS.  A chunk's token ids index its sorted word hashes; counts are of its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = [x for h in held for x in h[0]]
            used = [x for h in held for x in h[1]]
            counts = np.concatenate([h[2] for h in held])
            words, token = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            taught = np.repeat(np.array(used), counts)
            row = {
                "chunk": uuid4().hex, "doc_ids": ids, "held": [not x for x in used], "bounds": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes(),
                "tokens": _packed(token.astype(np.uint32)), "end": int(np.searchsorted(words, np.uint64(END))), "words": words.tobytes(), "counts": np.bincount(token[taught], minlength=len(words)).astype(np.uint32).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("bounds", pa.binary()), ("tokens", pa.binary()), ("end", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for piece in slices(batch):
                raw, offsets = buffers(piece.column("text"))
                w = Words(raw, offsets, NON_SPACE)
                # Each text's end follows its last word.
                hashes = np.insert(w.hash, w.bounds[1:], np.uint64(END))
                held.append((piece.column("doc_id").to_pylist(), piece.column("train").to_pylist(), w.counts + 1, hashes))
                size += len(raw)
                if size > CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train")).mapInArrow(run, _CHUNKS)


def _by_part(words: np.ndarray, parts: int) -> np.ndarray:
    """Cuts of sorted hashes into parts of the hash space."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def _ask(parts: int):
    """(part, chunk, words, counts) of each chunk's word list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(k) for k in range(3))):
                w, c = _u(words, np.uint64), _u(counts, np.uint32)
                cut = _by_part(w, parts)
                some = [(p, a, b) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array([chunk.as_py()] * len(some)), pa.array([w[a:b].tobytes() for _, a, b in some], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in some], pa.binary())], names=["part", "chunk", "words", "counts"])

    return run


def _summed(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.concatenate(words), np.concatenate(values).astype(np.int64)
    order = np.argsort(w)
    w, v = w[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return w[first], np.add.reduceat(v, first) if len(w) else v


def _total(table: pa.Table) -> pa.Table:
    """One part's distinct words and their counts in training."""
    w, c = _summed([_u(x, np.uint64) for x in table.column("words").combine_chunks()], [_u(x, np.uint32) for x in table.column("counts").combine_chunks()])
    return pa.table({"part": table.column("part")[:1], "words": pa.array([w.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary()), "n": pa.array([int(c.sum())]), "v": pa.array([int((c > 0).sum())])})


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts in zip(batch.column(0), batch.column(1)):
            w, c = _u(words, np.uint64), _u(counts, np.int64)
            best = np.lexsort((w, -c))[:HEAD]
            best = best[c[best] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(w[best].view(np.int64)), pa.array(c[best])], names=["word", "c"])


def _places(words: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Each word's place in the sorted head, or -1."""
    at = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return np.where(head[at] == words, at, -1)


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, texts' bounds, is training by text)."""
    token = _unpacked(row["tokens"], np.uint32).astype(np.int64)
    return token, _u(row["bounds"], np.int64), ~row["held"].values.to_numpy(zero_copy_only=False).astype(bool)


def _taught(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of the training texts, those before them); every text begins after an end."""
    token, bounds, teaches = _sequence(row)
    token = token[np.repeat(teaches, np.diff(bounds))]
    return token, np.concatenate([[row["end"].as_py()], token[:-1]]) if len(token) else token


def exchange(pairs: np.ndarray, counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words from their bigram counts: each word in turn goes to the class of highest class-bigram mutual information."""
    n = len(counts)
    classes = min(classes, max(1, n))
    of = np.empty(n, dtype=np.int64)
    of[np.argsort(-counts, kind="stable")] = np.arange(n) % classes
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    pairs = pairs.astype(np.float64)
    left_total, right_total = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-counts, kind="stable").tolist():
            out = np.bincount(of, pairs[w], minlength=classes)
            into = np.bincount(of, pairs[:, w], minlength=classes)
            own, here = pairs[w, w], of[w]
            out[here] -= own
            into[here] -= own
            table[here, :] -= out
            table[:, here] -= into
            table[here, here] -= own
            row, column = table.sum(axis=1) + into, table.sum(axis=0) + out  # the word's neighbours' classes have these anyway
            gain = (xlogx(table + out) - xlogx(table)).sum(axis=1) + (xlogx(table + into[:, None]) - xlogx(table)).sum(axis=0)
            diagonal = np.diagonal(table)
            gain += xlogx(diagonal + out + into + own) - xlogx(diagonal + out) - xlogx(diagonal + into) + xlogx(diagonal)
            gain -= xlogx(row + left_total[w]) - xlogx(row) + xlogx(column + right_total[w]) - xlogx(column)
            best = int(np.argmax(gain))
            table[best, :] += out
            table[:, best] += into
            table[best, best] += own
            of[w] = best
            moved += best != here
        if not moved:
            break
    return of


def _near(row: dict) -> pa.Table:
    """_NEAR of a chunk: how often each of its training words has each context; `at` has the steps from one place in the slice * CELLS + cell to the next.

    The row of part TABLE has the counts of class bigrams.
    """
    own, slices_ = _u(row["kinds"], np.uint8), _u(row["slices"], np.int64).reshape(-1, 2)
    token, before = _taught(row)
    left, right = own[before], own[token]
    both = (left != NO_CLASS) & (right != NO_CLASS)
    table = np.bincount(left[both].astype(np.int64) * CLASSES + right[both], minlength=CLASSES**2)
    cells = (token * CELLS + left)[left != NO_CLASS], (before * CELLS + CLASSES + right)[right != NO_CLASS], token[before == token] * CELLS + 2 * CLASSES
    small = np.int32 if len(own) * CELLS < 2**31 else np.int64
    code, times = np.unique(np.concatenate(cells).astype(small), return_counts=True)
    begin = np.concatenate([[0], np.cumsum(slices_[:, 1])]) * CELLS
    cut = np.searchsorted(code, begin.astype(small))
    rows = [(int(p), code[a:b] - base, times[a:b]) for p, a, b, base in zip(slices_[:, 0], cut[:-1], cut[1:], begin) if b > a]
    at = [_packed(np.diff(at, prepend=0).astype(np.uint32)) for _, at, _ in rows] + [b""]
    many = [_packed(n.astype(np.uint32)) for _, _, n in rows] + [_packed(table.astype(np.int64))]
    return pa.table({
        "part": pa.array([r[0] for r in rows] + [TABLE], pa.int32()), "chunk": pa.array([row["chunk"].as_py()] * (len(rows) + 1), pa.string()),
        "places": pa.nulls(len(rows) + 1, pa.binary()), "at": pa.array(at, pa.binary()), "times": pa.array(many, pa.binary()),
    })


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams, by cell."""
    total = np.zeros(CLASSES**2, dtype=np.int64)
    for batch in batches:
        for times in batch.column(0):
            total += _unpacked(times, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["k", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats a bigram."""
    n = max(table.sum(), 1)
    return float((_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum() + _xlogx(n)) / n)


def gains(table: np.ndarray, here: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each class gains from each word, as in exchange(), all others staying: (words, CLASSES).

    here: the words' classes (NO_CLASS: none).  into, out: counts of the classes before and after each, without
    the word itself.  own: how often the word follows itself.
    """
    size = len(table)
    has = np.flatnonzero(here != NO_CLASS)
    at = here[has]
    rows, columns = np.tile(table.sum(axis=1), (len(here), 1)), np.tile(table.sum(axis=0), (len(here), 1))
    # Row and column totals without the word in its class; its neighbours' counts stay, or come in with a word that has none.
    fresh = here == NO_CLASS
    rows[fresh] += into[fresh]
    columns[fresh] += out[fresh]
    rows[has, at] -= out[has].sum(axis=1) + own[has]
    columns[has, at] -= into[has].sum(axis=1) + own[has]
    gain = np.zeros((len(here), size))
    for counts, other, grid in ((out, into, table), (into, out, table.T)):
        w, c = np.nonzero(counts)
        n, g = counts[w, c], here[w]
        cell = grid[:, c].T.astype(np.float64)  # of each class against the neighbour's
        mine = np.flatnonzero(g != NO_CLASS)
        cell[mine, g[mine]] -= n[mine]
        same = np.flatnonzero(g == c)
        cell[same] -= other[w[same]]
        cell[same, g[same]] -= own[w[same]]
        term = _xlogx(cell + n[:, None]) - _xlogx(cell)
        begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
        if len(w):
            gain[w[begin]] += np.add.reduceat(term, begin, axis=0)
    diagonal = np.tile(np.diagonal(table).astype(np.float64), (len(here), 1))
    diagonal[has, at] -= out[has, at] + into[has, at] + own[has]
    gain += _xlogx(diagonal + out + into + own[:, None]) - _xlogx(diagonal + out) - _xlogx(diagonal + into) + _xlogx(diagonal)
    left, right = out.sum(axis=1, keepdims=True) + own[:, None], into.sum(axis=1, keepdims=True) + own[:, None]
    return gain - (_xlogx(rows + left) - _xlogx(rows) + _xlogx(columns + right) - _xlogx(columns))


def first_order(table: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> np.ndarray:
    """gains() to first order in the words' counts, which have to be small beside the table's, up to a constant of each word."""
    log = np.log(table + 0.5)
    rows, columns = np.log(table.sum(axis=1) + 0.5 * len(table)), np.log(table.sum(axis=0) + 0.5 * len(table))
    inner = out @ log.T + into @ log + own[:, None] * np.diagonal(log)
    return inner - (out.sum(axis=1) + own)[:, None] * rows - (into.sum(axis=1) + own)[:, None] * columns


def move(words: np.ndarray, here: np.ndarray, cells: np.ndarray, table: np.ndarray, exact: int = EXACT) -> np.ndarray:
    """New classes of words from their context cells.

    A word moves only where that gains.  One without a class or a classed neighbour yet is dealt one by its hash, as the
    head's words are by rank, and moves in a later step.
    """
    into, out, own = (x.astype(np.float64) for x in (cells[:, :CLASSES], cells[:, CLASSES : 2 * CLASSES], cells[:, -1]))
    has = np.flatnonzero(here != NO_CLASS)
    into[has, here[has]] -= own[has]
    out[has, here[has]] -= own[has]
    own = np.where(here != NO_CLASS, own, 0.0)
    gain = first_order(table, into, out, own)
    large = np.flatnonzero(np.maximum(into.sum(axis=1), out.sum(axis=1)) > exact)
    if len(large):
        gain[large] = gains(table, here[large].astype(np.int64), into[large], out[large], own[large])
    best = gain.argmax(axis=1)
    stay = np.where(here != NO_CLASS, here, best).astype(np.int64)
    each = np.arange(len(here))
    chosen = np.where(gain[each, best] > gain[each, stay] + 1e-9, best, stay)
    alone = (here == NO_CLASS) & ~(cells[:, : 2 * CLASSES] > 0).any(axis=1)
    return np.where(alone, words % np.uint64(CLASSES), chosen.astype(np.uint64)).astype(np.uint8)


def _move(sent, step: int):
    """One part's words in their new classes, by their contexts summed over the corpus; of the frequent ones with a class, the half whose turn it is moves."""

    def run(key, near: pa.Table, known: pa.Table) -> pa.Table:
        words, counts, here = (_u(known.column(c).combine_chunks()[0], k) for c, k in (("words", np.uint64), ("counts", np.int64), ("kinds", np.uint8)))
        places = {c.as_py(): np.cumsum(_unpacked(x, np.uint32), dtype=np.int64) for c, x in zip(near.column("chunk"), near.column("places")) if x.is_valid}
        codes, many = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for chunk, at, n in zip(near.column("chunk"), near.column("at"), near.column("times")):
            if at.is_valid:
                at = np.cumsum(_unpacked(at, np.uint32), dtype=np.int64)
                codes.append(places[chunk.as_py()][at // CELLS] * CELLS + at % CELLS)
                many.append(_unpacked(n, np.uint32))
        # Sums of whole numbers, exact up to 2 ** 53.
        cells = np.bincount(np.concatenate(codes), np.concatenate(many), minlength=len(words) * CELLS).reshape(-1, CELLS)
        kinds = here.copy()
        for a in range(0, len(words), 4096):
            b = a + 4096
            kinds[a:b] = np.where(counts[a:b] > 0, move(words[a:b], here[a:b], cells[a:b], sent.value), NO_CLASS)
        wait = (here != NO_CLASS) & (counts > EXACT) & ((words >> np.uint64(20)) % np.uint64(2) != step % 2)
        kinds[wait] = here[wait]
        return pa.table({**{c: known.column(c)[:1] for c in ("part", "words", "counts")}, "kinds": pa.array([kinds.tobytes()], pa.binary())})

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens of each class."""
    for batch in batches:
        for counts, kinds in zip(batch.column("counts"), batch.column("kinds")):
            c, kind = _u(counts, np.int64), _u(kinds, np.uint8)
            n = np.zeros(CLASSES, dtype=np.int64)
            np.add.at(n, kind[kind != NO_CLASS], c[kind != NO_CLASS])
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int64()), pa.array(n)], names=["k", "n"])


def _end_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, kinds in zip(batch.column("words"), batch.column("kinds")):
            at = np.flatnonzero(_u(words, np.uint64) == np.uint64(END))
            yield pa.RecordBatch.from_arrays([pa.array(_u(kinds, np.uint8)[at].astype(np.int32))], names=["kind"])


@dataclass(frozen=True)
class Totals:
    n: int  # training tokens
    v: int  # distinct ones


def score_texts(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of each text.

    `train` says which rows teach (never null).  Null text counts as empty: its end alone.
    base_score is the add-one unigram's.  Rows keep their number; ids may be null or equal, and other columns have any names.
    Without training rows every word is unknown; an empty table gives no rows.  Of equally good classes a word gets the first.
    Texts may be of any length; one text's tokens have to fit into a task.
    """
    work = Workspace(docs.sparkSession, "brown-lm")
    context = docs.sparkSession.sparkContext
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), train.alias("train"))
    chunks = work.write(_chunks(base, F.col("train")), "chunks")
    entries = chunks.agg(F.sum(F.length("words") / 8)).first()[0]
    if not entries:
        return base.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("held_out"), *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).limit(0)
    parts = max(2, int(-(-entries // PART)))

    totals = work.write(chunks.select("chunk", "words", "counts").mapInArrow(_ask(parts), "part int, chunk string, words binary, counts binary").groupBy("part").applyInArrow(_total, "part int, words binary, counts binary, n long, v long"), "totals")
    sums = totals.agg(F.sum("n"), F.sum("v")).first()
    size = Totals(int(sums[0]), int(sums[1]))
    top = totals.select("words", "counts").mapInArrow(_top, "word long, c long").orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = np.sort(np.append(top.column("word").to_numpy().view(np.uint64), np.uint64(END)) if END not in set(top.column("word").to_numpy().view(np.uint64).tolist()) else top.column("word").to_numpy().view(np.uint64))
    sent_head = context.broadcast(head)

    def head_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent_head.value
        total = np.zeros(len(head) ** 2, dtype=np.int64)
        for batch in batches:
            for row in _rows(batch):
                token, before = _taught(row)
                place = _places(_u(row["words"], np.uint64), head)
                place, before = place[token], place[before]
                both = (place >= 0) & (before >= 0)
                total += np.bincount(before[both] * len(head) + place[both], minlength=len(total))
        at = np.flatnonzero(total)
        stripe = at // 4096
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(stripe)) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
        rows = [(int(stripe[a]), at[a:b].astype(np.uint32).tobytes(), total[at[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.binary(), pa.binary()])], names=["stripe", "at", "times"])

    def add_pairs(table: pa.Table) -> pa.Table:
        at, times = _summed([_u(x, np.uint32) for x in table.column("at").combine_chunks()], [_u(x, np.int64) for x in table.column("times").combine_chunks()])
        return pa.table({"at": pa.array([at.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})

    pairs = np.zeros(len(head) ** 2, dtype=np.int64)
    for row in chunks.select("held", "bounds", "tokens", "end", "words").mapInArrow(head_pairs, "stripe int, at binary, times binary").groupBy("stripe").applyInArrow(add_pairs, "at binary, times binary").toArrow().to_pylist():
        pairs[np.frombuffer(row["at"], np.uint32)] = np.frombuffer(row["times"], np.int64)
    pairs = pairs.reshape(len(head), len(head))
    classes = exchange(pairs, pairs.sum(axis=0))
    sent_move = context.broadcast(classes)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = sent_head.value, sent_move.value
        for batch in batches:
            for row in _rows(batch):
                place = _places(_u(row["words"], np.uint64), head)
                kind = np.where((place >= 0) & (_u(row["counts"], np.int64) > 0), of[place], NO_CLASS).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c].as_py()], t) for c, t in (("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()))), pa.array([kind.tobytes()], pa.binary())], names=["part", "words", "counts", "kinds"])

    def find(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        """Where in the part each chunk's words are, as steps, and their counts."""
        words, counts = _u(known.column("words").combine_chunks()[0], np.uint64), _u(known.column("counts").combine_chunks()[0], np.int64)
        at = [np.searchsorted(words, _u(x, np.uint64)) for x in asked.column("words")]
        places, own = [_packed(np.diff(a, prepend=0).astype(np.uint32)) for a in at], [_packed(counts[a]) for a in at]
        return pa.table({"part": asked.column("part"), "chunk": asked.column("chunk"), "places": pa.array(places, pa.binary()), "counts": pa.array(own, pa.binary())})

    words = chunks.select("chunk", "words", "counts").mapInArrow(_ask(parts), "part int, chunk string, words binary, counts binary").select("part", "chunk", "words")
    words = words.groupBy("part").cogroup(totals.select("part", "words", "counts").groupBy("part"))
    index = work.write(words.applyInArrow(find, "part int, chunk string, places binary, counts binary"), "index")
    words = None

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        kinds = _u(known.column("kinds").combine_chunks()[0], np.uint8)
        own = [kinds[np.cumsum(_unpacked(x, np.uint32), dtype=np.int64)].tobytes() for x in asked.column("places")]
        return pa.table({"part": asked.column("part"), "chunk": asked.column("chunk"), "kinds": pa.array(own, pa.binary())})

    def join(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        reply = reply.sort_by("part")
        own = [x.as_py() for x in reply.column("kinds")]
        slices_ = np.stack([reply.column("part").to_numpy().astype(np.int64), np.array([len(x) for x in own])], 1)
        more = [pa.array([b"".join(own)], pa.binary()), pa.array([slices_.tobytes()], pa.binary())]
        return pa.Table.from_arrays([*(chunk.column(c) for c in ("chunk", *_TEXTS)), *more], names=[x.split()[0] for x in _READY.split(", ")])

    def with_kinds(classed: DataFrame, then, schema: str) -> DataFrame:
        """then(chunk with its words' classes) of each chunk."""
        answered = index.select("part", "chunk", "places").groupBy("part").cogroup(classed.select("part", "kinds").groupBy("part")).applyInArrow(answer, "part int, chunk string, kinds binary")
        return chunks.select("chunk", *_TEXTS).groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(lambda key, chunk, reply: then(join(chunk, reply)), schema)

    def tidy() -> None:
        gc.collect()  # lets Spark drop the shuffle files of plans that are done
        docs.sparkSession._jvm.System.gc()

    classed = work.write(totals.select("part", "words", "counts").mapInArrow(begin, _CLASSED), "classed0")
    tidy()
    step, information, last = 0, 0.0, None
    none = F.lit(None).cast("binary")
    while True:
        near = work.write(with_kinds(classed, lambda t: _near({c: t.column(c).combine_chunks()[0] for c in t.column_names}), _NEAR), f"near{step}")
        tidy()
        table = np.zeros(CLASSES**2)
        for k, n in near.filter(F.col("part") == TABLE).select("times").mapInArrow(_bigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            table[k] = n
        table = table.reshape(CLASSES, CLASSES)
        gained = _information(table)
        # The head's start (step 0) has few of the bigrams, so its information is not compared.
        if step > 1 and gained < information:  # neighbours that move together can miss each other: the step before stands
            final = last
            break
        if step > 2 and gained < information * (1 + LEAST_GAIN) or step and not gained:
            final = classed
            break
        both = near.filter(F.col("part") != TABLE).unionByName(index.select("part", "chunk", "places", none.alias("at"), none.alias("times")))
        moved = work.write(both.groupBy("part").cogroup(classed.groupBy("part")).applyInArrow(_move(context.broadcast(table), step), _CLASSED), f"classed{step + 1}")
        work.drop(f"near{step}")
        near = both = None
        tidy()
        last, classed, information, step = classed, moved, gained, step + 1
    work.drop(f"near{step}")
    ready = work.write(with_kinds(final, lambda t: t, _READY), "ready")
    tidy()
    sizes = np.zeros(CLASSES)
    for k, n in final.select("words", "counts", "kinds").mapInArrow(_sizes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[k] = n
    end_class = final.select("words", "kinds").mapInArrow(_end_kind, "kind int").first()[0]
    end_class = 0 if end_class == NO_CLASS else end_class  # without training, nothing has a class
    work.drop("chunks", "totals", *(f"classed{k}" for k in range(step + 1)))

    def history(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, class of each, and of the two known words before it in its text, texts' bounds, is training)."""
        token, bounds, teaches = _sequence(row)
        kind = _u(row["kinds"], np.uint8)[token].astype(np.int64)
        is_known = kind != NO_CLASS
        known = np.concatenate([[end_class, end_class], kind[is_known]])
        rank = np.cumsum(is_known) - is_known  # known words before
        own = rank - np.repeat(rank[bounds[:-1]], np.diff(bounds))  # of the same text
        return token, kind, np.where(own > 1, known[rank], end_class), np.where(own > 0, known[rank + 1], end_class), bounds, np.repeat(teaches, np.diff(bounds))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for row in _rows(batch):
                _, kind, g1, g2, _, taught = history(row)
                taught &= kind != NO_CLASS
                total += np.bincount((g1 * CLASSES + g2)[taught] * CLASSES + kind[taught], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // 1024), pa.array(at), pa.array(total[at])], names=["stripe", "at", "times"])

    counted = ready.select("held", "bounds", "tokens", "kinds").mapInArrow(transitions, "stripe long, at long, times long").groupBy("at").agg(F.sum("times").alias("times")).toArrow()
    cube = np.zeros(CLASSES**3)
    cube[counted.column("at").to_numpy()] = counted.column("times").to_numpy()
    cube = cube.reshape(CLASSES, CLASSES, CLASSES)
    single = (cube.sum(axis=(0, 1)) + 1e-3) / (cube.sum() + 1e-3 * CLASSES)
    two = cube.sum(axis=0)
    two = (two + 5 * single) / (two.sum(axis=1, keepdims=True) + 5)
    three = (cube + 10 * two[None]) / (cube.sum(axis=2, keepdims=True) + 10)
    sent = context.broadcast(((L3 * three + L2 * two[None] + L1 * single).ravel(), np.maximum(sizes, 1)))

    def score(key, chunk: pa.Table, reply: pa.Table) -> pa.Table:
        mixed, size_of = sent.value
        row = {name: chunk.column(name).combine_chunks()[0] for name in chunk.column_names}
        token, kind, g1, g2, bounds, _ = history(row)
        c = np.concatenate([_unpacked(x, np.int64) for x in reply.sort_by("part").column("counts")]).astype(np.float64)
        own = _u(row["kinds"], np.uint8)
        plain = (c + 1) / (size.n + size.v + 1)
        emit = np.where(own != NO_CLASS, c / size_of[np.minimum(own, CLASSES - 1)], 0)
        unknown = 1 / (size.n + size.v + 1)
        p = (1 - unknown) * mixed[(g1 * CLASSES + g2) * CLASSES + np.minimum(kind, CLASSES - 1)] * emit[token] + L0 * plain[token]
        p[kind == NO_CLASS] = unknown
        total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  each text has its end
        n = len(bounds) - 1
        return pa.table({
            "doc_id": row["doc_ids"].values, "held_out": row["held"].values, "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(total((c > 0)[token].astype(np.int64))),
            "train_tokens": pa.array(np.full(n, size.n)), "base_score": pa.array(total(np.log10(plain)[token])), "score": pa.array(total(np.log10(p))),
        })

    counted = index.select("part", "chunk", "counts")
    return ready.select("chunk", *_TEXTS, "kinds").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
