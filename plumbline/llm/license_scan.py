"""Licence scans: runs of words compared with licence templates by the Dice coefficient of word bigrams.

Texts are normalised to lower-case words of letters and digits.  A run of words A,
wherever lines break, matches a template B when 2 |A & B| / (|A| + |B|) >= threshold over distinct word bigrams.  Size bounds
prune: |A| must lie between |B| t / (2 - t) and |B| (2 - t) / t, and a text that does not hold
|B| t / (2 - t) of a template's bigrams at all cannot match it.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._bytes import ALNUM, Words, buffers, slices

# Public licence notices and texts.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: Sentences that grant a licence, and what licences are called in them; each licence has a notice of each sentence.
SENTENCES = {
    "licensed": "Licensed under the {name}.",
    "terms": "This project is licensed under the terms of the {name}.",
    "released": "Released under {name}.",
    "spdx": "SPDX-License-Identifier: {id}",
}
NAMES = {
    "MIT": "MIT license", "ISC": "ISC license", "Apache-2.0": "Apache License 2.0", "BSD-2-Clause": "BSD 2-Clause license", "BSD-3-Clause": "BSD 3-Clause license", "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1", "LGPL-3.0": "GNU Lesser General Public License v3.0", "AGPL-3.0": "GNU Affero General Public License v3.0", "MPL-2.0": "Mozilla Public License 2.0", "EPL-2.0": "Eclipse Public License 2.0",
    "Unlicense": "Unlicense license", "CC0-1.0": "CC0 1.0 Universal license", "CC-BY-SA-4.0": "CC BY-SA 4.0 license", "CC-BY-ND-4.0": "CC BY-ND 4.0 license",
}
TEMPLATES |= {f"{id}-notice-{kind}": sentence.format(name=name, id=id) for id, name in NAMES.items() for kind, sentence in SENTENCES.items()}
# Whole texts and standard headers.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted((files(__package__) / "licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

MATCHES = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType()),
    T.StructField("common", T.LongType()), T.StructField("n_bigrams", T.LongType()), T.StructField("dice", T.DoubleType()),
]))


def _bigrams(words: Words) -> np.ndarray:
    """The bigram that begins at each word; 0 at a text's last word."""
    out = np.zeros(len(words.hash), dtype=np.uint64)
    out[:-1] = words.hash[:-1] * np.uint64(0xA0761D6478BD642F) + words.hash[1:] if len(out) else out[:-1]
    last = words.bounds[1:][words.counts > 0] - 1
    out[last] = 0
    return out


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = sorted(templates), threshold
        words = Words(*buffers(pa.array([templates[n] for n in self.names], pa.large_string())), ALNUM)
        grams = _bigrams(words)
        self.sets = [np.unique(grams[a:b][grams[a:b] != 0]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
        self.vocabulary = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.has = np.stack([np.isin(self.vocabulary, s) for s in self.sets], 1) if self.sets else np.zeros((0, 0), bool)
        size = np.array([len(s) for s in self.sets], dtype=np.float64)
        self.least, self.most = np.ceil(size * threshold / (2 - threshold) - 1e-9), np.floor(size * (2 - threshold) / threshold + 1e-9)

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """The runs of words of each text that match a template."""
        words = Words(raw, offsets, ALNUM)
        gram, owner = _bigrams(words), words.text_of()
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        if not len(self.vocabulary) or not len(gram):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, gram), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == gram)
        pair = np.unique(owner[hit] * len(self.vocabulary) + at[hit])
        held = np.zeros((len(out), len(self.sets)), dtype=np.int32)
        np.add.at(held, pair // len(self.vocabulary), self.has[pair % len(self.vocabulary)])
        for text in np.flatnonzero(((held >= self.least) & (self.least > 0)).any(axis=1)).tolist():
            a, b = words.bounds[text], words.bounds[text + 1]
            line = np.concatenate([[0], np.cumsum(raw[offsets[text] : offsets[text + 1]] == 10)])[words.start[a:b] - offsets[text]]
            places = _Places(gram[a:b])
            runs = [x for t in np.flatnonzero((held[text] >= self.least) & (self.least > 0)).tolist() for x in self._runs(gram[a:b], places, line, t, int(held[text, t]))]
            out[text] = [x for _, _, x in sorted(_apart(runs, b - a), key=lambda r: (r[2]["license"], r[0]))]
        return out

    def _runs(self, gram: np.ndarray, places: _Places, line: np.ndarray, t: int, held: int) -> list[tuple[int, int, dict]]:
        """(first word, end, match) of the runs over the threshold that do not overlap, the best first taken, in the text's order."""
        member = np.isin(gram, self.sets[t])
        found, stretches = [], [(0, len(gram))]
        while stretches:  # what lies between the runs taken is searched again
            low, high = stretches.pop()
            taken = []
            used = np.zeros(high - low, dtype=bool)
            for minus, length, begin, size, common in sorted(self._best_of_starts(member, places, t, held, low, high)):
                # A run's last bigram takes a word more.
                if used[begin - low]:
                    continue
                if used[begin - low : begin + length - low + 1].any():
                    break  # this start may have a shorter run, which the next search finds
                used[begin - low : begin + length - low + 1] = True
                taken.append((begin, begin + length + 1))
                found.append((begin, begin + length + 1, {"license": self.names[t], "first_line": int(line[begin]), "last_line": int(line[begin + length]), "common": common, "n_bigrams": size, "dice": -minus}))
            if taken:
                taken.sort()
                stretches += zip([low, *(e for _, e in taken)], [*(b for b, _ in taken), high])
        return found

    def _best_of_starts(self, member: np.ndarray, places: _Places, t: int, held: int, low: int, high: int) -> list[tuple]:
        """(-Dice, length, begin, bigrams, common ones) of the best run from each matched bigram on, within [low, high) and over the threshold.

        A best run begins and ends with a matched bigram, and its first bigram does not come again in it: without it
        the run would be as good and shorter. So a run ends before its first bigram's next place, behind no matched bigram, and
        where its bigrams exceed the bound or all that the text holds are in.
        """
        # A run's words end before `high`, and so its last bigram begins before high - 1.
        edge = high if high == len(member) else max(low, high - 1)
        starts = np.flatnonzero(member[low:edge]) + low
        if len(starts) < self.least[t]:
            return []
        stops = np.minimum(places.next[starts], starts[-1] + 1)  # starts[-1] is before the edge
        room = stops - starts >= self.least[t]
        out, target, most = [], len(self.sets[t]), int(self.most[t])
        for begin, stop in zip(starts[room].tolist(), stops[room].tolist()):
            reach, at = most + 16, None
            while True:
                end = min(begin + reach, stop)
                at = places.firsts(begin, end)
                common = np.cumsum(member[at])
                if end >= stop or len(at) > most or common[-1] >= held:
                    break
                reach *= 4
            size = np.arange(1, len(at) + 1)
            dice = np.where(size <= most, 2 * common / (size + target), 0)
            k = int(np.argmax(dice))
            if common[k] >= self.least[t] and dice[k] >= self.threshold:
                out.append((-float(dice[k]), int(at[k]) - begin + 1, begin, k + 1, int(common[k])))
        return out


class _Places:
    """Where a text's bigrams come again: the place before and the next place of each, and the least place before of each block."""

    BLOCK = 256

    def __init__(self, gram: np.ndarray):
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        self.before, self.next = np.full(len(gram), -1, dtype=np.int64), np.full(len(gram), len(gram), dtype=np.int64)
        self.before[order[1:][same]] = order[:-1][same]
        self.next[order[:-1][same]] = order[1:][same]
        whole = len(gram) // self.BLOCK * self.BLOCK
        self.block = self.before[:whole].reshape(-1, self.BLOCK).min(axis=1)

    def firsts(self, begin: int, end: int) -> np.ndarray:
        """The places in [begin, end) whose bigram does not come before in it; blocks without any are passed over whole."""
        a, z = -(-begin // self.BLOCK), end // self.BLOCK
        if z - a < 4:
            return np.flatnonzero(self.before[begin:end] < begin) + begin
        blocks = np.flatnonzero(self.block[a:z] < begin) + a
        at = np.concatenate([np.arange(begin, a * self.BLOCK), (blocks[:, None] * self.BLOCK + np.arange(self.BLOCK)).ravel(), np.arange(z * self.BLOCK, end)])
        return at[self.before[at] < begin]


def _apart(runs: list[tuple[int, int, dict]], n: int) -> list[tuple[int, int, dict]]:
    """Without the runs of which most lies in one of more common bigrams, as of another version of the licence."""
    used, kept = np.zeros(n, dtype=bool), []
    for begin, end, match in sorted(runs, key=lambda r: (-r[2]["common"], -r[2]["dice"], r[0])):
        if 2 * np.count_nonzero(used[begin:end]) <= end - begin:
            used[begin:end] = True
            kept.append((begin, end, match))
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, into: str = "licenses", text_column: str = "text") -> DataFrame:
    """docs with an array column `into` (which replaces one of that name) of matches in order of their names.

    A match has the licence, the first and last line of its run (counted from 0), the common and own
    bigrams, and the Dice coefficient.  A template has all its runs that do not overlap, in the text's
    order (best taken first; ties: the shortest, then the first).  Of runs of several templates on the
    same words, the one with the most common bigrams stays.  Null, empty and
    one-word texts match nothing; copies match alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, threshold))
    out = docs.drop(into)
    at = out.columns.index(text_column)
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("common", pa.int64()), ("n_bigrams", pa.int64()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_column):
                found = held.value.scan(*buffers(piece.column(at)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, kind)], names=[*piece.schema.names, into])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(into, MATCHES)]))
