"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i) ** 2 - sum_i v_if ** 2 x_i ** 2))

The pairwise part takes time linear in a text's features.  A hashed word's feature is its
share of the text's words; a structure statistic, in buckets, is an indicator, so word and
statistic pairs interact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._bytes import NON_SPACE, Words, buffers, byte_class, slices

WORD_BITS, FACTORS = 14, 8
BUCKETS = 12
#: The bounded sample: texts of each label, and their bytes in all.
SAMPLE, SAMPLE_BYTES = {1: 1800, 0: 1000}, 9 << 20
EPOCHS, RATE, BATCH, DECAY = 12, 0.02, 64, 1e-4

_UPPER, _DIGIT = byte_class([(65, 90)]), byte_class([(48, 57)])
_MARK, _SYMBOL = byte_class([(33, 33), (63, 63)]), np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_IN_LINE = ~byte_class([(10, 10)])
_LETTER = byte_class([(65, 90), (97, 122), (128, 255)])
STATISTICS = ("words", "bytes", "word_size", "upper", "digit", "mark", "symbol", "letter", "line", "dup_line", "distinct", "adjacent", "repeat")
N_FEATURES = (1 << WORD_BITS) + len(STATISTICS) * BUCKETS


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (run[bounds[1:]] - run[bounds[:-1]]).astype(np.float64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, text bounds): each text's distinct features.  A text without words has only statistics."""
    words = Words(raw, offsets, NON_SPACE, fold=False)
    n_texts, n, owner = len(offsets) - 1, words.counts.astype(np.float64), words.text_of()
    size = np.diff(offsets).astype(np.float64)
    many = np.maximum(n, 1)
    letters = np.maximum(_sums(_LETTER[raw], offsets), 1)
    # Words by text and hash: distinct ones, and the share of the commonest statistics.
    order = np.lexsort((words.hash, owner))
    h, o = words.hash[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n_texts)
    same = np.zeros(len(owner), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    five = words.hash.copy()
    for k in range(1, 5):
        five[:-k] = five[:-k] * np.uint64(0xD6E8FEB86659FD93) + words.hash[k:] if len(five) > k else five[:-k]
    order5 = np.lexsort((five, owner))
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (five[order5][1:] == five[order5][:-1]) & (owner[order5][1:] == owner[order5][:-1])
    lines = Words(raw, offsets, _IN_LINE, fold=False)
    line_owner = lines.text_of()
    order_l = np.lexsort((lines.hash, line_owner))
    dup = np.zeros(len(line_owner), dtype=bool)
    dup[1:] = (lines.hash[order_l][1:] == lines.hash[order_l][:-1]) & (line_owner[order_l][1:] == line_owner[order_l][:-1])
    n_lines = np.maximum(lines.counts, 1)
    shares = {
        "words": np.log2(1 + n) / 15, "bytes": np.log2(1 + size) / 18, "word_size": np.minimum(1, size / many / 16),
        "upper": _sums(_UPPER[raw], offsets) / letters, "digit": np.minimum(1, 5 * _sums(_DIGIT[raw], offsets) / np.maximum(size, 1)),
        "mark": np.minimum(1, _sums(_MARK[raw], offsets) / many / 2), "symbol": np.minimum(1, _sums(_SYMBOL[raw], offsets) / many / 2),
        "letter": letters / np.maximum(size, 1), "line": np.minimum(1, n_lines / many), "dup_line": np.bincount(line_owner[order_l][dup], minlength=n_texts) / n_lines,
        "distinct": distinct / many, "adjacent": np.bincount(owner[same], minlength=n_texts) / many, "repeat": np.bincount(owner[order5][again], minlength=n_texts) / many,
    }
    statistic = np.stack([k * BUCKETS + np.where(x <= 0, 0, 1 + np.minimum(BUCKETS - 2, (np.sqrt(np.clip(x, 0, 1)) * (BUCKETS - 1)).astype(np.int64))) for k, x in enumerate(shares[s] for s in STATISTICS)], 1) + (1 << WORD_BITS)
    bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    code = np.sort(o * (1 << WORD_BITS) + bucket)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(code)))
    word_text, word_feature = code[first] >> WORD_BITS, code[first] & ((1 << WORD_BITS) - 1)
    text = np.concatenate([word_text, np.repeat(np.arange(n_texts), len(STATISTICS))])
    feature = np.concatenate([word_feature, statistic.ravel()])
    value = np.concatenate([times / many[word_text], np.full(statistic.size, 1 / len(STATISTICS))])
    by = np.argsort(text, kind="stable")
    return feature[by], value[by], np.searchsorted(text[by], np.arange(n_texts + 1))


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, feature: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        v = self.factors[feature] * value[:, None]
        start = bounds[:-1]  # no text is without features
        sums = np.add.reduceat(v, start, axis=0)
        squares = np.add.reduceat((v * v).sum(axis=1), start)
        return self.bias + np.add.reduceat(self.linear[feature] * value, start) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(raw, offsets)), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray) -> FactorisationMachine:
    """Adam on the logistic loss, labels weighed alike.  Constant if a label is missing."""
    if not len(texts) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean(), 0.01, 0.99)) if len(texts) else 0.5
        return FactorisationMachine(float(np.log(rate / (1 - rate))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))
    rng = np.random.Generator(np.random.PCG64(11))
    parts, most = [], 0
    for k in range(0, len(texts), 200):
        some = texts[k : k + 200]
        f, v, b = features(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
        parts += [(f[a:c], v[a:c]) for a, c in zip(b[:-1], b[1:])]
        most = max(most, int(np.diff(b).max()))
    cost = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    bias, linear, factors = np.zeros(1), np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, FACTORS))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, linear, factors)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            f, v = np.concatenate([parts[r][0] for r in rows]), np.concatenate([parts[r][1] for r in rows])
            many = np.array([len(parts[r][0]) for r in rows])
            bounds = np.concatenate([[0], np.cumsum(many)])
            model = FactorisationMachine(float(bias[0]), linear, factors)
            error = cost[rows] * (1 / (1 + np.exp(-np.clip(model.margins(f, v, bounds), -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(error, many) * v
            vf = factors[f] * v[:, None]
            sums = np.repeat(np.add.reduceat(vf, bounds[:-1], axis=0), many, axis=0)
            used, place = np.unique(f, return_inverse=True)
            grads = [np.array([error.sum()]), np.bincount(place, each, minlength=len(used)), np.stack([np.bincount(place, each * (sums - vf)[:, c], minlength=len(used)) for c in range(FACTORS)], 1)]
            step += 1
            for p, (m, s), g, at in zip((bias, linear, factors), state, grads, (slice(None), used, used)):
                g = g + DECAY * p[at]
                m[at] = 0.9 * m[at] + 0.1 * g
                s[at] = 0.999 * s[at] + 0.001 * g * g
                p[at] -= RATE * (m[at] / (1 - 0.9 ** min(step, 1000))) / (np.sqrt(s[at] / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(bias[0]), linear, factors)


def score_quality(docs: DataFrame, model: FactorisationMachine, into: str = "quality", text_column: str = "text") -> DataFrame:
    """docs with a double column `into` (which replaces one of that name): the probability of label 1.

    Null, empty and wordless texts are scored by their statistics alone.  Equal texts get equal scores.
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
