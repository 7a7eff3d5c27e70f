"""Exact set-similarity self-join on word shingles, with token-combination prefixes.

Two texts link when |A & B| / |A | B| >= percent / 100 for their sets of word
shingles.  Every set orders its shingles by one global order and indexes only a
prefix of it:

* rare shingles are indexed one by one (those of one set alone can meet no other
  and are only counted);
* frequent shingles fall into sub-classes by hash, and only combinations of two
  shingles of the same sub-class are indexed.

With e = n - ceil(percent * n / 100) shingles that a linked partner may lack, a
prefix is long enough when (rare in it) + sum over sub-classes of
max(0, in it - 1) > e: whatever e shingles are missing, a whole signature
remains, and both partners' prefixes hold it.  The number of sub-classes depends
on the size level (power of two) of a set; a set is indexed at each level that a
linked partner could have.

The global order is (half of the hash space, frequency class, hash), so a prefix
almost always ends within the first half and only that half of a set's shingles is
counted; a set whose first half might not be enough sends all.  Shingles travel as
packed arrays, shortened to 32 bits within a part; what that confuses costs a
candidate and is put right by the check on whole sets.

Sets that are equal are one node, so copies cost nothing.  No pair of nodes is ever a
row.  A bucket gives memberships (hub, node), where the hub is its least node; buckets of
one hub are one group, and the whole sets of a group meet in a task, which compares those
that are not connected yet (sketches first, then in full) and returns a spanning forest of
the group's links.

A group of more than GROUP nodes is dealt out in chunks, and some of its nodes go to every
chunk.  One of these, of least distance to the others, is the group's leader O.  Nodes that
link with O are connected.  For any other node A let D(A) be the symmetric difference of A and O.  If A does not link with O, then |D(A)| exceeds
c (|A| + |O|), with c = (100 - percent) / (100 + percent), and a node B that links with A has
|D(A) ^ D(B)| <= c (|A| + |B|) <= c (|A| + |O| + |D(B)|) < |D(A)| + c |D(B)|, so D(A) and D(B)
have an element in common.  So each node of the group is put under elements of its
difference (a prefix of them, rare ones first: see `_differences`), and these are the groups
of the next level, without those that are connected by now.  That goes on until no group is left;
the leader is in none of them, so each is smaller than the one that it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._bytes import NON_SPACE, Words, buffers, mix, shingles, slices
from ._shared import Workspace
from .components import connected_components

U64 = np.uint64
#: A shingle in at least 2 ** FREQUENT sets is frequent.
FREQUENT = 6
#: Entries of a signature that 2 ** HOT sets or more could have are not gathered: each is a membership by itself.
HOT = 18
#: In buckets up to this size every pair is looked at before its nodes are named.
SMALL_BUCKET = 12
#: Nodes of a group that are compared in one task (a second or two for texts of some hundred words), and their shingles.
GROUP, GROUP_SHINGLES = 4096, 4 << 20
#: Nodes of a larger group that go to all its chunks, at most.
LEADERS = 16
BLOB = 16 << 20
#: Bytes of whole sets that meet in a task, about, if no group has more.
BLOCK = 8 << 20


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(piece, shingles, bounds) for pieces of a batch with a text column."""
    for piece in slices(batch):
        raw, offsets = buffers(piece.column("text"))
        value, owner = shingles(Words(raw, offsets, NON_SPACE), width)
        yield piece, value, np.searchsorted(owner, np.arange(piece.num_rows + 1))


def _keys(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for an empty one."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    some = n > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(value ^ U64(0x5BF03635)), bounds[:-1][some]) + n[some].astype(np.uint64)) | U64(1)
    return out


def _lacks(n: np.ndarray | int, percent: int):
    """The most shingles of a set of n that a linked set may lack."""
    return n - (percent * n + 99) // 100


def _classes(level: int) -> int:
    return max(1, (1 << level) // 8)


def _levels(n: int, percent: int) -> range:
    """The size levels of all sets that a set of n may link with."""
    return range(((n * percent + 99) // 100).bit_length() - 1, (n * 100 // percent).bit_length())


def signatures(n: int, alone: tuple[int, int], token: np.ndarray, kind: np.ndarray, late: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, places, classes) of a set of n: of its shared tokens with their frequency classes and halves, and the number alone in each half.

    A place is the number of the set's tokens before the signature's first one in the global order.
    A class is the least frequency class of the signature's tokens: fewer than 2 ** (class + 1) sets have it.
    """
    e = int(_lacks(n, percent))
    if alone[0] > e:
        return token[:0], np.zeros(0, np.uint32), kind[:0]
    order = np.lexsort((token, kind, late))
    token, kind, late = token[order], kind[order], late[order]
    frequent = kind >= FREQUENT
    before = alone[0] + alone[1] * late  # those in no other set come first in their half
    place = (np.arange(len(token)) + before).astype(np.uint32)
    if not frequent.any():
        use = place <= e
        return token[use], place[use], kind[use]
    out, at_place, of_kind = [], [], []
    for level in _levels(n, percent):
        classes = _classes(level)
        group = (mix(token ^ U64(0xC1A55)) & U64(classes - 1)).astype(np.int64)
        group[~frequent] = -1
        by = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by], np.arange(-1, classes + 1))
        rank = np.empty(len(token), dtype=np.int64)
        rank[by] = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
        gain = ~frequent | (rank > 0)
        budget = np.cumsum(gain) + before
        length = min(len(token), int(np.searchsorted(budget, e + 1)) + 1)
        used = np.arange(len(token)) < length
        out.append(token[used & ~frequent])
        at_place.append(place[used & ~frequent])
        of_kind.append(kind[used & ~frequent])
        own = by[used[by] & frequent[by]]
        own_rank, own_token = rank[own], token[own]
        back = 1
        while (own_rank >= back).any():  # each with the back-th before it in its sub-class
            at = np.flatnonzero(own_rank >= back)
            out.append(mix(own_token[at] * U64(0x9E3779B97F4A7C15) + mix(own_token[at - back]) + U64(level)))
            at_place.append(place[own[at - back]])
            of_kind.append(np.minimum(kind[own[at]], kind[own[at - back]]))
            back += 1
    sig, first = np.unique(np.concatenate(out), return_index=True)
    return sig, np.concatenate(at_place)[first], np.concatenate(of_kind)[first]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    chunks = [np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c]
    return np.concatenate(chunks) if chunks else np.zeros(0, kind)


_SENT = "part int, nodes binary, sizes binary, counts binary, tokens binary"
_SIGNED = "part int, sigs binary, nodes binary, sizes binary, places binary, alone binary"
_CLASSED = "chunk int, nodes binary, sizes binary, alone binary, counts binary, tokens binary, kinds binary"


def _send(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Each part's share of the sets' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            node, n, count, value = (np.concatenate(x) for x in zip(*held))
            owner = np.repeat(np.arange(len(node)), count)
            part = ((value >> U64(32)) * U64(parts)) >> U64(32)
            order = np.argsort(part.astype(np.int32) if parts > 32767 else part.astype(np.int16), kind="stable")
            part, owner, value = part[order], owner[order], value[order]
            token = ((value & U64(0x7FFFFFFF)) | ((value >> U64(40)) & U64(1)) << U64(31)).astype(np.uint32)
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                if b > a:
                    first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                    own = owner[a:b][first]
                    rows.append((p, node[own].tobytes(), n[own].astype(np.uint32).tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), token[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names=["part", "nodes", "sizes", "counts", "tokens"])

        for batch in batches:
            for _, value, bounds in _sets(batch, width):
                n, node = np.diff(bounds), _keys(value, bounds)
                late = ((value >> U64(40)) & U64(1)).astype(bool)
                early = np.diff(_starts(~late)[bounds])
                most = np.array([_classes(_levels(int(x), percent)[-1]) if x > 1 else 0 for x in n.tolist()])
                whole = early < _lacks(n, percent) + 1 + most
                fresh = np.zeros(len(n), dtype=bool)
                fresh[np.unique(node, return_index=True)[1]] = True  # copies in one piece are sent once
                fresh &= n > 1  # smaller sets link with equal ones only
                take = np.repeat(fresh, n) & (np.repeat(whole, n) | ~late)
                count = np.diff(_starts(take)[bounds])
                held.append((node[fresh], n[fresh], count[fresh], value[take]))
                size += int(count.sum())
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, _SENT)


def _classify(table: pa.Table, chunks: int) -> pa.Table:
    """Of one part: in how many sets each shingle is, sent on to the sets' chunks."""
    part = U64(table.column("part")[0].as_py())
    node, n, count, token = _column(table, "nodes", np.uint64), _column(table, "sizes", np.uint32), _column(table, "counts", np.uint32).astype(np.int64), _column(table, "tokens", np.uint32)
    first = np.zeros(len(node), dtype=bool)
    first[np.unique(node, return_index=True)[1]] = True
    token, node, n, count = token[np.repeat(first, count)], node[first], n[first], count[first]
    owner = np.repeat(np.arange(len(node)), count)
    order = np.argsort(token)
    start = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    times = np.diff(np.append(start, len(token)))
    kind = np.empty(len(token), dtype=np.uint8)
    kind[order] = np.repeat(np.floor(np.log2(times)).astype(np.uint8), times)
    single = np.zeros(len(token), dtype=bool)
    single[order] = np.repeat(times == 1, times)
    late = (token >> np.uint32(31)).astype(bool)
    alone = np.stack([np.bincount(owner[single & (late == half)], minlength=len(node)) for half in (False, True)], 1).astype(np.uint32)
    name = mix((part << U64(32) | token.astype(np.uint64)) + U64(0x70CE2)) >> U64(1) | late.astype(np.uint64) << U64(63)
    shared = np.flatnonzero(~single)
    name, kind, owner = name[shared], kind[shared], owner[shared]
    many = np.bincount(owner, minlength=len(node)).astype(np.uint32)
    chunk = (node % U64(chunks)).astype(np.int64)
    by = np.argsort(chunk, kind="stable")
    begin = _starts(many)
    rows = []
    for own in np.split(by, np.flatnonzero(np.diff(chunk[by])) + 1) if len(by) else []:
        at = np.repeat(begin[own] - _starts(many[own])[:-1], many[own]) + np.arange(int(many[own].sum()))
        rows.append((int(chunk[own[0]]), node[own].tobytes(), n[own].tobytes(), alone[own].tobytes(), many[own].tobytes(), name[at].tobytes(), kind[at].tobytes()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6)], names=[x.split()[0] for x in _CLASSED.split(", ")])


def _sign(table: pa.Table, percent: int, parts: int) -> pa.Table:
    """Of one chunk of sets: their signatures, sent to the signatures' parts."""
    node, n, many = _column(table, "nodes", np.uint64), _column(table, "sizes", np.uint32), _column(table, "counts", np.uint32).astype(np.int64)
    alone = _column(table, "alone", np.uint32).reshape(-1, 2)
    token, kind = _column(table, "tokens", np.uint64), _column(table, "kinds", np.uint8)
    key, group = np.unique(node, return_inverse=True)
    size = np.zeros(len(key), dtype=np.int64)
    size[group] = n
    lone = np.stack([np.bincount(group, alone[:, k], minlength=len(key)) for k in (0, 1)], 1).astype(np.int64)
    owner = np.repeat(group, many)
    order = np.argsort(owner, kind="stable")
    token, kind = token[order], kind[order]
    cut = np.searchsorted(owner[order], np.arange(len(key) + 1))
    sig, place, freq, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero((lone[:, 0] <= _lacks(size, percent)) & (np.diff(cut) > 0)):
        a, b = cut[k], cut[k + 1]
        own, at, classes = signatures(int(size[k]), (int(lone[k, 0]), int(lone[k, 1])), token[a:b], kind[a:b], token[a:b] >> U64(63), percent)
        sig.append(own)
        place.append(at)
        freq.append(classes)
        of.append(np.full(len(own), k))
    sig, place, freq, of = np.concatenate(sig), np.concatenate(place), np.concatenate(freq), np.concatenate(of)
    part = (mix(sig ^ U64(0x5157)) % U64(parts)).astype(np.int64)
    hot = freq >= HOT
    part[hot] = parts + (mix(key[of[hot]] ^ U64(0x407)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sig, place, of, part = sig[order], place[order], of[order], part[order]
    cut = np.searchsorted(part, np.arange(2 * parts + 1))
    rows = [
        (p, sig[a:b].tobytes(), key[of[a:b]].tobytes(), size[of[a:b]].astype(np.uint32).tobytes(), place[a:b].tobytes(), lone[of[a:b], 0].astype(np.uint32).tobytes())
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:]))
        if b > a
    ]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] + [pa.binary()] * 5)], names=[x.split()[0] for x in _SIGNED.split(", ")])


_MEMBER = "hub long, node long, n int"


def _could(percent: int, n, m, p, q, u, v) -> np.ndarray:
    """Whether sets of n and m shingles, u and v of them (of the first half) in no other set, could link if p and q come before a shared one.

    Shingles that are in no other set come first in the order, so the sets share at most
    min(p - u, q - v) + 1 + min(n - p - 1, m - q - 1), and min(n - u, m - v).
    """
    common = np.minimum(np.maximum(np.minimum(p - u, q - v), 0) + 1 + np.minimum(n - p - 1, m - q - 1), np.minimum(n - u, m - v))
    return (percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (100 * common >= percent * (n + m - common))


def _members(table: pa.Table, percent: int, parts: int) -> pa.Table:
    """Of one part's blobs: (hub, node, n) of each bucket's nodes that could link with another one of it."""
    sig, node, n = _column(table, "sigs", np.uint64), _column(table, "nodes", np.uint64).view(np.int64), _column(table, "sizes", np.uint32).astype(np.int64)
    if table.column("part")[0].as_py() >= parts:  # not gathered by signature
        return pa.table({"hub": pa.array(sig.view(np.int64)), "node": pa.array(node), "n": pa.array(n.astype(np.int32))})
    place, alone = _column(table, "places", np.uint32).astype(np.int64), _column(table, "alone", np.uint32).astype(np.int64)
    order = np.lexsort((node, n, sig))
    again = np.concatenate([[False], (sig[order][1:] == sig[order][:-1]) & (node[order][1:] == node[order][:-1])]) if len(order) else np.zeros(0, bool)
    order = order[~again]
    sig, node, n, place, alone = sig[order], node[order], n[order], place[order], alone[order]
    # A bucket ends where the sizes of its sets leave a gap that no link can cross.
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (percent * n[1:] > 100 * n[:-1])]) if len(sig) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    many = np.diff(np.append(start, len(sig)))
    use = np.repeat(many > SMALL_BUCKET, many)
    for size in range(2, SMALL_BUCKET + 1):
        first = start[many == size]
        for x in range(size if len(first) else 0):
            for y in range(x + 1, size):
                i, j = first + x, first + y
                both = _could(percent, n[i], n[j], place[i], place[j], alone[i], alone[j])
                use[i[both]] = use[j[both]] = True
    hub = np.repeat(np.minimum.reduceat(node, start), many) if len(start) else node
    hub, node, n = hub[use], node[use], n[use]
    order = np.lexsort((node, hub))
    hub, node, n = hub[order], node[order], n[order]
    fresh = np.concatenate([[True], (hub[1:] != hub[:-1]) | (node[1:] != node[:-1])]) if len(hub) else np.zeros(0, bool)
    return pa.table({"hub": pa.array(hub[fresh]), "node": pa.array(node[fresh]), "n": pa.array(n[fresh].astype(np.int32))})


def _tokens(base: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(block, node, tokens) of the wanted (node, doc_id, blocks), read from the texts again."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["block", "node", "tokens"])

        for batch in batches:
            for piece, value, bounds in _sets(batch, width):
                keys, blocks = _keys(value, bounds).view(np.int64), piece.column("blocks")
                for r in np.flatnonzero(keys == piece.column("node").to_numpy()):  # another row of the same id may have another text
                    tokens = value[bounds[r] : bounds[r + 1]].tobytes()
                    for b in blocks[int(r)].as_py():
                        out.append((b, int(keys[r]), tokens))
                        size += len(tokens)
                        if size > BLOB // 4:
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    texts = base.join(wanted.withColumnRenamed("doc_id", "wanted_id"), base["doc_id"].eqNullSafe(F.col("wanted_id")))
    return texts.select("text", "node", "blocks").mapInArrow(fetch, "block int, node long, tokens binary")


def _apart(n, m, percent: int):
    """The most shingles that are in one of two linked sets of n and m only."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, whether an odd number of its shingles falls on each bit: two sketches differ in no more bits than the sets in shingles."""
    bits = 1 << min(max(8, int(np.mean([len(x) for x in sets])).bit_length()), 14)
    out = np.empty((len(sets), bits // 64), dtype=np.uint64)
    for k, x in enumerate(sets):
        out[k] = np.packbits((np.bincount((x >> U64(7)) & U64(bits - 1), minlength=bits) & 1).astype(bool)).view(np.uint64)
    return out


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles a set shares with each of others."""
    tokens = np.concatenate(others)
    at = np.searchsorted(one, tokens)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == tokens).astype(np.int64), _starts(np.array([len(x) for x in others]))[:-1])


def _connect(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels of the connected components of the sets (sorted, not empty) by their links; a label is the place of one of its sets."""
    count = len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    n = np.array([len(sets[k]) for k in order], dtype=np.int64)
    upto = np.searchsorted(n, n * 100 // percent, side="right")
    label = np.arange(count)
    sketch = _sketches([sets[k] for k in order]) if count > 2 else None
    for i in range(count - 1):
        j = np.arange(i + 1, upto[i])
        j = j[label[j] != label[i]]
        if len(j) and sketch is not None:
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= _apart(n[i], n[j], percent)]
        done = 0
        while done < len(j):  # some at a time, as the first links make others needless
            some = j[done : done + 64]
            done += 64
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            common = _shared(sets[order[i]], [sets[order[k]] for k in some])
            linked = some[100 * common >= percent * (n[i] + n[some] - common)]
            if len(linked):
                label[np.isin(label, label[linked])] = label[i]
    out = np.empty(count, dtype=np.int64)
    out[order] = order[label]
    return out


class _Leaders:
    """The leader of a group that is in chunks, and how common elements of differences from it are, by the nodes that go to all chunks."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        n = np.array([len(x) for x in sets])
        apart = [int((n + len(x) - 2 * _shared(x, sets)).sum()) for x in sets]
        self.leader, self.percent = sets[int(np.argmin(apart))], percent
        self.seen, self.times = np.unique(np.concatenate([self._all(x) for x in sets]), return_counts=True)

    def _all(self, own: np.ndarray) -> np.ndarray:
        more, less = np.setdiff1d(own, self.leader, assume_unique=True), np.setdiff1d(self.leader, own, assume_unique=True)
        return np.concatenate([mix(more), ~mix(less)])

    def differences(self, own: np.ndarray) -> np.ndarray:
        """Signed elements of a set's symmetric difference D from the leader, as many as the first that must meet those of any set that links.

        If A and B link, the differences D and E share at least (|D| + |E| - x) / 2 elements, where x bounds the size of the
        symmetric difference of A and B; as |E| >= |D| - x, that is at least |D| - x.  So, all in one order, the first
        x + 1 elements of D and those of E meet.
        """
        most = (len(own) + len(own) * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        out = self._all(own)
        if len(out) > most + 1 and len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, out), len(self.seen) - 1)
            out = out[np.lexsort((out, np.where(self.seen[at] == out, self.times[at], 0)))]
        return out[: most + 1]


_FOUND = "kind int, a long, b long, n int"


def _compare(percent: int):
    """Of one block: kind 0, (a, b) that say that node b is connected with a; kind 1, the memberships (hub, node, n) of the next level."""

    def run(key, groups: pa.Table, sets: pa.Table) -> pa.Table:
        tokens = (np.frombuffer(x.as_buffer(), np.uint64) for c in sets.column("tokens").chunks for x in c)
        have = dict(zip(sets.column("node").to_pylist(), tokens))
        groups = groups.sort_by([("part", "ascending"), ("node", "ascending"), ("leads", "descending")])
        part, node, hub, leads = (groups.column(c).to_numpy() for c in ("part", "node", "hub", "leads"))
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
        kinds, a, b, n = [], [], [], []
        for x, y in zip(edges[:-1], edges[1:]):
            own, first = np.unique(node[x:y], return_index=True)
            all_sets = [have[k] for k in own.tolist()]
            label = _connect(all_sets, percent)
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, label, own)
            moved = least[label] != own
            kinds.append(np.zeros(int(moved.sum()), np.int32))
            a.append(least[label][moved])
            b.append(own[moved])
            n.append(np.zeros(int(moved.sum()), np.int32))
            at = np.flatnonzero(leads[x:y][first])
            if len(at):  # a chunk of a larger group
                leaders = _Leaders([all_sets[k] for k in at], percent)
                for k in range(len(own)):
                    under = mix(leaders.differences(all_sets[k]) ^ hub[x : x + 1].view(np.uint64)).view(np.int64)
                    kinds.append(np.ones(len(under), np.int32))
                    a.append(under)
                    b.append(np.full(len(under), own[k]))
                    n.append(np.full(len(under), len(all_sets[k]), np.int32))
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), t)
        return pa.table({"kind": cat(kinds, pa.int32()), "a": cat(a, pa.int64()), "b": cat(b, pa.int64()), "n": cat(n, pa.int32())})

    return run


def _deal(members: DataFrame, work: Workspace, level: int) -> tuple[DataFrame, bool, bool]:
    """(block, part, hub, node, n, leads): the memberships of groups of two or more, of large ones in chunks with the same few nodes in each; whether there are any, and any in chunks."""
    h = F.xxhash64("node", F.lit(level))
    firsts = [F.min(F.when(F.pmod(h, F.lit(LEADERS)) == k, F.struct(h.alias("h"), "node", "n"))) for k in range(LEADERS)]
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("shingles"), F.array_compact(F.array(*firsts)).alias("leaders")).filter("many > 1")
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("many") / F.lit(GROUP)), F.ceil(F.col("shingles") / F.lit(GROUP_SHINGLES))))
    own = members.join(sizes.select("hub", "chunks", F.when(F.col("chunks") > 1, F.col("leaders.node")).alias("leading")), "hub")
    own = own.select("hub", F.pmod(h, "chunks").alias("chunk"), "node", "n", F.coalesce(F.array_contains("leading", F.col("node")), F.lit(False)).alias("leads"))
    led = sizes.filter("chunks > 1").select("hub", "leaders", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    led = led.select("hub", "chunk", F.inline("leaders")).select("hub", "chunk", "node", "n", F.lit(True).alias("leads"))
    parts = own.unionByName(led).withColumn("part", F.xxhash64("hub", "chunk"))
    parts = work.write(parts.select("part", "hub", "node", "n", "leads"), f"groups-{level}")
    size, chunked = parts.agg(F.sum("n"), F.max("leads")).first()
    blocks = max(2, -(-(size or 0) * 8 // BLOCK))
    return parts.withColumn("block", F.pmod("part", F.lit(blocks)).cast("int")), bool(size), bool(chunked)


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs, whatever the names of its other columns.

    component_id is the smallest id reachable by links, itself included.  Words are
    [^\\x20\\x09-\\x0D]+ with A-Z folded; a text of fewer words than `width` (one at
    least) has its whole sequence as its one shingle.  A text that is null, empty or
    without words has no shingles and is a component of its own.  Rows with equal
    texts share a component, and so do repeated rows; an empty table gives no rows.
    Null ids are allowed: they are kept, and are the component only of a group without other ids.
    Texts may be of any length; one text's shingles have to fit into a task.
    Sets are told apart by 64 bits: among N different ones N * N / 2 ** 65 are expected to be confused.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def describe(batches):
        for batch in batches:
            for piece, value, bounds in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(bounds)), pa.array(_keys(value, bounds).view(np.int64))], names=["doc_id", "n_shingles", "node"])

    described = work.write(base.mapInArrow(describe, "doc_id long, n_shingles long, node long"), "described")
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(2, -(-total * 4 // BLOB))
    sent = _send(base, width, percent, parts).groupBy("part").applyInArrow(lambda t: _classify(t, parts), _CLASSED)
    signed = sent.groupBy("chunk").applyInArrow(lambda t: _sign(t, percent, parts), _SIGNED)
    members = signed.groupBy("part").applyInArrow(lambda t: _members(t, percent, parts), _MEMBER)
    nodes = described.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    links = labels = None
    level = 0
    while True:
        members = work.write(members.groupBy("hub", "node").agg(F.max("n").alias("n")), f"members-{level}")
        dealt, some, chunked = _deal(members, work, level)
        if not some:
            break
        wanted = dealt.groupBy("node").agg(F.collect_set("block").alias("blocks")).join(nodes, "node").select("node", "doc_id", "blocks")
        found = dealt.groupBy("block").cogroup(_tokens(base, wanted, width).groupBy("block")).applyInArrow(_compare(percent), _FOUND)
        found = work.write(found, f"found-{level}")
        new = found.filter("kind = 0").select("a", "b")
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links, work, f"labels-{level}")
        if not chunked:
            break
        # Of the next level, only groups that are not connected yet.
        under = found.filter("kind = 1").select(F.col("a").alias("hub"), F.col("b").alias("node"), "n")
        known = under.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        known = work.write(known, f"under-{level}")
        apart = known.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("hub")
        members = known.join(apart, "hub", "left_semi").select("hub", "node", "n")
        level += 1

    if labels is None:
        per_node = nodes.select("node", F.col("doc_id").alias("component"))
    else:
        named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = named.groupBy("label").agg(F.min("doc_id").alias("component"))
        per_node = named.join(lowest, "label").select("node", "component")
    per_node = work.write(per_node, "per-node")
    work.drop(*(f"{x}-{k}" for k in range(level + 1) for x in ("members", "groups", "found", "under", "labels")))
    joined = described.filter("n_shingles > 0").join(per_node, "node", "left")
    none = described.filter("n_shingles = 0")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
