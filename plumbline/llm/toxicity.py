"""Toxicity: a support vector machine on a subsequence string kernel, with Nystrom landmarks.

The unit is a word (long ones in overlapping pieces; runs of single letters are joined to
one).  Two units are alike as far as they share subsequences of three characters, gaps
allowed: a subsequence that spans g characters weighs DECAY ** (g - 3), up to a span of
SPAN, so inserted characters weaken a match and do not end it.  The kernel is normalised to
k(x, x) = 1.  Landmark units give Nystrom features
K(Z, Z) ** -1/2 k(Z, x), on which a linear machine with squared hinge loss is trained.  As
the kernel is a sum over subsequences, the trained machine is one weight for each
subsequence, and a unit is scored by look-ups.

Labels are of texts: each toxic text lends its highest-scored unit as the positive example
(first: units far more frequent in toxic texts), and the machine is trained again.  A text's
score is a logistic function of its highest unit score.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._bytes import NON_SPACE, Words, buffers, slices

Model = TypeVar("Model")

DECAY, SPAN = 0.6, 6
#: Symbols: 0 begins a unit, 1-26 a-z, 27-46 other letters by code point, 47 anything else.
SYMBOLS = 48
#: Units of more symbols are cut into pieces of PIECE that begin every STEP.
PIECE, STEP = 20, 10
#: The bounded sample: texts of each label, and their bytes in all (shared by label in proportion).
SAMPLE, SAMPLE_BYTES = {1: 800, 0: 2000}, 9 << 20
#: It is drawn from so many times as many labelled ids; texts of more bytes than this come last.
CANDIDATES, LONGEST = 4, 64 << 10
LANDMARKS, ROUNDS = 256, 3
#: The bounded sample's clean words: as many at random and, from the second round on, as many of the highest-scored.
NEGATIVES, HARD = 4000, 4000

_ASCII = np.full(256, 47, dtype=np.int32)
_ASCII[97:123] = np.arange(1, 27)
_OFFSETS = [(a, a + b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


class Units:
    """Units of a buffer of texts: a matrix of symbols (0 first, -1 after the end), grouped by equal words, and the texts that have them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets, NON_SPACE)
        data, owner = words.data, words.text_of()
        start, end, key = words.start, words.end, words.hash
        # A letter is an ASCII byte or the first byte of a longer code point; its symbol mixes the code point's bytes.
        lead = (data & 0xC0) != 0x80
        symbol = _ASCII[data]
        wide = np.flatnonzero(lead & (data >= 0xC3))
        following = data[np.minimum(wide + 1, len(data) - 1)].astype(np.int32)
        folded = np.where(data[wide] == 0xC3, following | 0x20, following)  # Latin-1 capitals and small letters alike
        symbol[wide] = 27 + (folded + data[wide].astype(np.int32) * 7) % 20
        position = np.concatenate([[0], np.cumsum(lead)])
        symbols = symbol[lead]
        begin, length = position[start], position[end] - position[start]
        # Runs of three single letters or more become one unit more.
        single = (length == 1) & (symbols[np.minimum(begin, max(len(symbols) - 1, 0))] < 47) if len(symbols) else np.zeros(0, bool)
        extra = self._runs(single, owner)
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # (symbols, unit) by length
        units_begin, units_length = begin[first], length[first]
        self.unit_of_word, self.owner, self.n_texts = group, owner, len(offsets) - 1
        self.first, self.words = first, words
        pieces_begin, pieces_length, pieces_unit = [], [], []
        short = units_length <= PIECE
        unit = np.arange(len(first))
        pieces_begin.append(units_begin[short])
        pieces_length.append(units_length[short])
        pieces_unit.append(unit[short])
        for u in np.flatnonzero(~short):
            at = np.arange(0, units_length[u] - PIECE + STEP, STEP)
            pieces_begin.append(units_begin[u] + at)
            pieces_length.append(np.minimum(PIECE, units_length[u] - at))
            pieces_unit.append(np.full(len(at), u))
        self.n_units = len(first)
        begin_, length_, unit_ = (np.concatenate(x) for x in (pieces_begin, pieces_length, pieces_unit))
        for n in np.unique(length_):
            own = length_ == n
            matrix = np.zeros((int(own.sum()), int(n) + 1), dtype=np.int32)
            matrix[:, 1:] = symbols[begin_[own][:, None] + np.arange(n)]
            self.rows.append((matrix, unit_[own]))
        self.joined: list[tuple[np.ndarray, int]] = [(np.concatenate([[0], symbols[begin[a:b]]]).astype(np.int32), int(owner[a])) for a, b in extra]

    @staticmethod
    def _runs(single: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        if not len(single):
            return []
        first = single.copy()
        first[1:] &= ~(single[:-1] & (owner[1:] == owner[:-1]))
        start = np.flatnonzero(first)
        stop = single.copy()
        stop[:-1] &= ~(single[1:] & (owner[1:] == owner[:-1]))
        end = np.flatnonzero(stop) + 1
        out = []
        for a, b in zip(start.tolist(), end.tolist()):
            if b - a >= 3:
                out += [(x, min(x + PIECE, b)) for x in range(a, max(a + 1, b - PIECE + STEP), STEP)]
        return out

    def scores(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """The score of each distinct unit: its highest piece's."""
        out = np.full(self.n_units, -np.inf)
        for matrix, unit in self.rows:
            np.maximum.at(out, unit, unit_scores(matrix, weight, bias))
        return out

    def text_scores(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """The highest unit score of each text; -inf without words."""
        out = np.full(self.n_texts, -np.inf)
        unit = self.scores(weight, bias)
        if len(self.owner):
            cut = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
            out[self.owner[cut]] = np.maximum.reduceat(unit[self.unit_of_word], cut)
        for row, text in self.joined:
            out[text] = max(out[text], float(unit_scores(row[None, :], weight, bias)[0]))
        return out

    def unit_text(self, unit: int) -> bytes:
        w = self.first[unit]
        return bytes(self.words.data[self.words.start[w] : self.words.end[w]])


def _codes(matrix: np.ndarray, near: int, far: int) -> np.ndarray:
    n = matrix.shape[1] - far
    return (matrix[:, :n] * SYMBOLS + matrix[:, near : near + n]) * SYMBOLS + matrix[:, far : far + n]


def unit_scores(matrix: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Scores of rows of symbols of one length: the weighted sum over their subsequences by their norm, and the bias."""
    total = np.zeros(len(matrix))
    for near, far in _OFFSETS:
        if matrix.shape[1] > far:
            total += weight[_codes(matrix, near, far)].sum(axis=1) * DECAY ** (far - 2)
    out = np.empty(len(matrix))
    for at in range(0, len(matrix), 2000):
        out[at : at + 2000] = total[at : at + 2000] / _true_norms(matrix[at : at + 2000]) + bias
    return out


def _true_norms(matrix: np.ndarray) -> np.ndarray:
    codes = np.concatenate([_codes(matrix, near, far) for near, far in _OFFSETS if matrix.shape[1] > far] or [np.zeros((len(matrix), 0), np.int32)], axis=1)
    if not codes.shape[1]:
        return np.ones(len(matrix))
    value = np.concatenate([np.full(matrix.shape[1] - far, DECAY ** (far - 2)) for _, far in _OFFSETS if matrix.shape[1] > far])
    order = np.argsort(codes, axis=1)
    flat = (np.take_along_axis(codes, order, axis=1).astype(np.int64) + np.arange(len(matrix))[:, None] * SYMBOLS**3).ravel()
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    sums = np.add.reduceat(value[order].ravel(), first)
    return np.sqrt(np.bincount(first // codes.shape[1], sums * sums, minlength=len(matrix)))


def _features(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of one unit in the kernel's own space, normalised."""
    code = [_codes(row[None, :], near, far)[0] for near, far in _OFFSETS if len(row) > far]
    if not code:
        return np.zeros(0, np.int64), np.zeros(0)
    value = np.repeat([DECAY ** (far - 2) for _, far in _OFFSETS if len(row) > far], [len(c) for c in code])
    codes, group = np.unique(np.concatenate(code), return_inverse=True)
    sums = np.bincount(group, value)
    return codes, sums / np.sqrt((sums * sums).sum())


def _variants(row: np.ndarray) -> list[np.ndarray]:
    """A unit as it would be disguised: a mark between all its letters or two of them, a letter put in, a letter doubled."""
    n = len(row)
    if n < 5:
        return []
    gapped = np.full(2 * n - 2, 47, dtype=row.dtype)
    gapped[0], gapped[1::2] = 0, row[1:]
    out = [gapped]
    for at in (3, n // 2 + 1, n - 1):
        out += [np.insert(row, at, 47), np.insert(row, at, 1 + (int(row[at]) * 7 + at) % 26), np.insert(row, at, row[at])]
    return out


def _without_copies(pairs: np.ndarray, seen: np.ndarray, texts: int) -> np.ndarray:
    """The (text, unit) pairs of texts that do not share most of their rare units with one text before."""
    first: dict[int, int] = {}
    keep = []
    rare = seen <= max(2, texts // 50)
    cuts = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0], [True]])) if len(pairs) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = [u for u in pairs[a:b, 1].tolist() if rare[u]]
        before = Counter(first[u] for u in own if u in first)
        if not (own and before and before.most_common(1)[0][1] * 2 > len(own)):
            keep.append(pairs[a:b])
            for u in own:
                first.setdefault(u, int(pairs[a, 0]))
    return np.concatenate(keep) if keep else pairs[:0]


def _cover(pairs: np.ndarray, clean: np.ndarray, texts: int) -> np.ndarray:
    """Units that explain toxic texts: again and again the one that is in most texts not yet explained, and in next to no clean text.

    Words that copies of a toxic text share are not taken, as their texts are explained by then.
    """
    pairs = pairs[clean[pairs[:, 1]] == 0] if (clean[pairs[:, 1]] == 0).any() else pairs
    chosen: list[int] = []
    while len(pairs):
        count = np.bincount(pairs[:, 1])
        best = int(np.argmax(count))
        if chosen and count[best] < max(2, texts // 500):
            break
        chosen.append(best)
        pairs = pairs[~np.isin(pairs[:, 0], pairs[pairs[:, 1] == best, 0])]
    return np.array(chosen, dtype=np.int64)


def _landmarks(feats: list[tuple[np.ndarray, np.ndarray]], many: int, near: float = 0.75) -> list[int]:
    """The first units, in the order given, that are no nearer than `near` to one chosen before."""
    chosen: list[int] = []
    stack = np.zeros((SYMBOLS**3, many), dtype=np.float32)
    for k, (c, v) in enumerate(feats):
        if len(chosen) == many:
            break
        if len(c) and (not chosen or float((v @ stack[c, : len(chosen)]).max()) < near):
            stack[c, len(chosen)] = v
            chosen.append(k)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps for the squared hinge loss with costs c; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # of each subsequence
    bias: float
    slope: float
    shift: float
    base_rate: float

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text; the base rate's if it has no words."""
        best = Units(raw, offsets).text_scores(self.weight, self.bias)
        score = self.slope * np.where(np.isfinite(best), best, 0) + self.shift
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(score, -30, 30))), self.base_rate)


def train(texts: list[bytes], labels: np.ndarray) -> ToxicityModel:
    """A model of labelled texts; a constant one if a label is missing."""
    if not len(texts) or labels.min() == labels.max():
        rate = min(0.49, float(labels.mean())) if len(texts) else 0.0
        return ToxicityModel(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log((rate + 1e-6) / (1 - rate))), rate)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    units = Units(np.frombuffer(b"".join(texts), np.uint8), offsets)
    pair = np.unique(np.stack([units.owner, units.unit_of_word], 1), axis=0)
    toxic = labels == 1
    seen = [np.bincount(pair[mask[pair[:, 0]], 1], minlength=units.n_units) for mask in (toxic, ~toxic)]
    own = _without_copies(pair[toxic[pair[:, 0]]], seen[0] + seen[1], len(texts))
    often = np.bincount(own[:, 1], minlength=units.n_units)
    witness = np.unique(np.concatenate([_cover(own, seen[1], int(toxic.sum())), np.flatnonzero((seen[1] == 0) & (often >= max(8, toxic.sum() // 25)))]))
    symbols = {}
    for matrix, unit in units.rows:
        for k, u in enumerate(unit.tolist()):
            symbols.setdefault(u, matrix[k])
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def features(u: int) -> tuple[np.ndarray, np.ndarray]:
        if u not in known:
            known[u] = _features(symbols[u])
        return known[u]

    rng = np.random.Generator(np.random.PCG64(7))
    clean = np.flatnonzero((seen[1] > 0) & (seen[0] <= 4 * seen[1]))
    by_text = np.searchsorted(pair[:, 0], np.arange(len(texts) + 1))
    toxic_texts = np.flatnonzero(toxic & (np.diff(by_text) > 0))
    hard = np.zeros(0, dtype=np.int64)
    for step in range(ROUNDS):
        witness = witness[np.argsort(-seen[0][witness], kind="stable")]
        negative = np.unique(np.concatenate([rng.permutation(clean)[:NEGATIVES], hard]))
        frequent = witness[: max(1, int((often[witness] >= max(4, toxic.sum() // 50)).sum()))]
        varied = [_features(v) for u in frequent.tolist() for v in _variants(symbols[u])]
        few = [features(u) for u in rng.permutation(negative)[: LANDMARKS * 2].tolist()]
        candidates = [[features(u) for u in witness.tolist()], varied, few]
        chosen = [some[k] for some, share in zip(candidates, (2, 1, 1)) for k in _landmarks(some, LANDMARKS * share // 4)]
        z = np.zeros((len(chosen), SYMBOLS**3), dtype=np.float32)
        for k, (c, v) in enumerate(chosen):
            z[k, c] = v
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        keep = values > 1e-4
        root = vectors[:, keep] / np.sqrt(values[keep])
        rows = [*map(features, witness.tolist()), *varied, *map(features, negative.tolist())]
        k = np.zeros((len(rows), len(chosen)))
        for i, (c, v) in enumerate(rows):
            k[i] = z[:, c] @ v
        positive = len(witness) + len(varied)
        y = np.where(np.arange(len(rows)) < positive, 1.0, -1.0)
        cost = np.where(y > 0, 10.0 * max(1.0, len(negative) / max(1, positive) / 4), 10.0)
        w, bias = _svm(k @ root, y, cost)
        direction = root @ w
        # Some columns at a time, as the product takes z in double precision; z is gone before the next one is made.
        weight = np.concatenate([z[:, c : c + 4096].T @ direction for c in range(0, z.shape[1], 4096)]).astype(np.float32)
        del z, rows, k
        score = units.scores(weight, bias)
        if step + 1 < ROUNDS:
            best = np.array([own[np.argmax(score[own])] for own in (pair[by_text[t] : by_text[t + 1], 1] for t in toxic_texts)])
            fresh = np.unique(np.concatenate([witness, best[score[best] > 0]]))
            fresh = fresh[(score[fresh] > -0.5) & (seen[1][fresh] == 0)]
            witness = fresh if len(fresh) >= 5 else witness
            over = clean[score[clean] > -0.8]
            hard = over[np.argsort(-score[over])][:HARD]
    best = units.text_scores(weight, bias)
    have = np.isfinite(best)
    x = best[have]
    t = labels[have].astype(float)
    share = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, len(t) - t.sum()))
    loss = lambda a, b: float((share * np.logaddexp(0, np.where(t == 1, -1, 1) * (a * x + b))).sum() + 5e-4 * a * a)
    a, b = 3.0, 0.0
    for _ in range(50):  # logistic calibration, labels weighed alike
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(share * (p - t) * x).sum() + 1e-3 * a, (share * (p - t)).sum()])
        q = share * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        move, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and not loss(a - size * move[0], b - size * move[1]) <= loss(a, b):
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(size * move).max() < 1e-5 or size <= 1e-4:
            break
    a = max(float(a), 0.1)
    return ToxicityModel(weight, bias, float(a), float(b), min(0.49, float(labels.mean())))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, texts_per_label: dict[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> DataFrame:
    """(t, y, o): texts and labels of a bounded, reproducible sample of labelled training rows (crc32 of the id not divisible by 5).

    Each label takes texts in hash order of their ids, up to its number and its share of most_bytes, from the first
    CANDIDATES times that many labelled ids. Texts of more than `longest` bytes come behind all others, the shortest first,
    so a long text takes no other's place; a label's first text is taken at any size, so no label that has a candidate with
    a text is left out. Rows with a null id, text or label are left out. An id counts once, however often either table has
    it: with its largest label, and the shortest (then least) of its texts. Empty tables give no rows; other columns are
    not read. Only ids and lengths are ranked; texts are fetched for the ids that were chosen.
    """
    hashed = F.xxhash64("doc_id")
    trainable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    once = trainable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    candidates = None
    for y in (0, 1):
        part = once.filter(F.col("y") == y).orderBy(hashed, "doc_id").limit(CANDIDATES * texts_per_label[y])
        candidates = part if candidates is None else candidates.unionByName(part)
    texts = docs.filter("text is not null").select("doc_id", "text", F.octet_length("text").cast("long").alias("n"))
    sized = texts.select("doc_id", "n").join(F.broadcast(candidates), "doc_id").groupBy("doc_id", "y").agg(F.min("n").alias("n"))
    by_size = Window.partitionBy("y").orderBy(F.when(F.col("n") > longest, F.col("n")).otherwise(0), hashed, "doc_id")
    running = F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    share = {y: most_bytes * n // sum(texts_per_label.values()) for y, n in texts_per_label.items()}
    within = lambda y: (F.col("y") == y) & (F.col("rank") <= texts_per_label[y]) & (F.col("running") <= share[y])
    ranked = sized.select("doc_id", "y", F.row_number().over(by_size).alias("rank"), running.alias("running"))
    chosen = ranked.filter((F.col("rank") == 1) | within(0) | within(1))
    found = texts.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("n", "text")).alias("x"))
    return found.select(F.encode("x.text", "utf-8").alias("t"), "y", hashed.alias("o"))


def fit(sample: DataFrame, train: Callable[[list[bytes], np.ndarray], Model]) -> Model:
    """train(texts, labels) of a bounded sample, in one task; the model alone comes to the driver."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("y", "ascending")])
        model = train([x.as_py() for x in table.column("t")], table.column("y").to_numpy().astype(np.int64))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.withColumn("all", F.col("y") * 0).groupBy("all").applyInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else train([], np.zeros(0, np.int64))


def score_toxicity(docs: DataFrame, model: ToxicityModel, into: str = "toxicity", text_column: str = "text") -> DataFrame:
    """docs with a double column `into` (which replaces one of that name): 0 to 1, higher for toxic.

    Null, empty and wordless texts get the sample's share of toxic texts, under a half.
    Every word of every text is scored; equal texts get equal scores.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop(into)
    at = out.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_column):
                raw, offsets = buffers(piece.column(at))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(held.value.probability(raw, offsets))], names=[*piece.schema.names, into])

    return out.mapInArrow(run, out.withColumn(into, F.lit(0.0)).schema)
