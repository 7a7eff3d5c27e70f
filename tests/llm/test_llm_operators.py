"""The operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import brown_lm, byte_bpe, components, decontamination, fm_index, license_scan, ngram_join, quality_fm, quality_rules, token_files, toxicity, url_cascade
from plumbline.llm._bytes import NON_SPACE, Words, buffers, shingles, word_hash
from plumbline.llm._shared import Workspace

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("d", "f", "gan", "hel", "jo", "mer", "pik", "sut")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, **more):
    rows = [(k if t != "NOID" else None, None if t == "NULL" else t, "x", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, score int")


EDGES = ["NULL", "", " \t\n", "one", "a b c", "NOID", "é" * 300, "x " * 30000, "!!! ### $$$", "same words here again", "same words here again"]


def test_words_and_shingles():
    texts = ["Ab  cD\tab", "", "ab", "ab cd ab cd ab"]
    w = Words(*buffers(pa.array(texts)), NON_SPACE)
    assert w.counts.tolist() == [3, 0, 1, 5] and int(w.hash[0]) == word_hash(b"ab") == int(w.hash[3])
    value, owner = shingles(w, 2)
    assert np.bincount(owner, minlength=4).tolist() == [2, 0, 1, 2]


def components_by_force(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else [])))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def near_copies(rng, count, words, edits):
    """Copies of one text, each with words put in other words' places."""
    base = prose(rng, words).split()
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + rng.choice("xyz")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("frequent,hot,small,group", [(6, 18, 12, 1024), (1, 18, 2, 1024), (2, 4, 4, 20)])
def test_similarity_components(spark, monkeypatch, frequent, hot, small, group):
    """Against brute force: as it is, with few small buckets, with groups in chunks, and with hot signatures."""
    for name, value in (("FREQUENT", frequent), ("HOT", hot), ("SMALL_BUCKET", small), ("GROUP", group)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    texts = [t for n in (5, 9, 9, 30, 30, 30, 90, 90, 90, 90, 200) for t in near_copies(rng, 6, n, [0, 1, 2])]
    texts += near_copies(rng, 40, 60, [1, 2, 3]) + near_copies(rng, 30, 120, [2, 4, 6])
    passage = prose(rng, 40)
    texts += [passage + " " + prose(rng, rng.choice([3, 20])) for _ in range(10)] + [None, "", " ", "one two", "ONE two", "solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.similarity_components(docs, 4, 85).orderBy("doc_id").collect()
    root, sizes = components_by_force(texts, 4, 85)
    assert [r["component_id"] for r in got] == root and [r["n_shingles"] for r in got] == sizes


def test_large_group_of_near_copies(spark, monkeypatch):
    """2,000 near copies, whose links make more than one component, in chunks and in one group."""
    rng = random.Random(8)
    texts = near_copies(rng, 2000, 40, [0, 1, 2, 2, 3, 3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sets = [frozenset(zip(*(t.split()[k:] for k in range(4)))) for t in texts]
    of: dict = {}
    distinct = [of.setdefault(s, s) for s in sets]
    names = {s: k for k, s in enumerate(dict.fromkeys(distinct))}
    vocabulary = {x: k for k, x in enumerate({x for s in names for x in s})}
    rows = np.zeros((len(names), len(vocabulary)), dtype=np.float32)
    for s, k in names.items():
        rows[k, [vocabulary[x] for x in s]] = 1
    common, n = rows @ rows.T, rows.sum(axis=1)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    label = np.arange(len(names))
    while True:
        new = np.where(linked, label[None, :], len(names)).min(axis=1)
        if (new == label).all():
            break
        label = new
    first: dict = {}
    want = [first.setdefault(int(label[names[s]]), k) for k, s in enumerate(distinct)]
    assert len(first) > 5
    for group in (1024, 100):
        monkeypatch.setattr(ngram_join, "GROUP", group)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(docs, 4, 85).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_sets_apart():
    """Sketches never refuse a link, and differences from a leader meet for every link that the leader does not make."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = []
        for _ in range(120):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.12, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(np.arange(40, dtype=np.uint64), rng.integers(0, 12))])))
        inter = lambda x, y: len(np.intersect1d(x, y))
        link = lambda x, y: 100 * inter(x, y) >= percent * (len(x) + len(y) - inter(x, y))
        sketch = ngram_join._sketches(sets)
        leaders = ngram_join._Leaders(sets[:5], percent)
        leader = leaders.leader
        under = [set(leaders.differences(x).tolist()) for x in sets]
        for i in range(len(sets)):
            for j in range(i):
                if link(sets[i], sets[j]):
                    assert np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= ngram_join._apart(len(sets[i]), len(sets[j]), percent)
                    assert (link(sets[i], leader) and link(sets[j], leader)) or under[i] & under[j]
        label = ngram_join._connect(sets, percent)
        assert len(set(label.tolist())) == len({min(k for k in range(len(sets)) if label[k] == x) for x in label})


def test_similarity_edges(spark):
    got = ngram_join.similarity_components(frame(spark, EDGES), 4, 85).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(EDGES) and by_id[9]["component_id"] == by_id[10]["component_id"] == 9 and by_id[None]["component_id"] is None
    assert by_id[0]["n_shingles"] == by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == 0 and by_id[7]["n_shingles"] == 1
    assert ngram_join.similarity_components(frame(spark, [])).count() == 0


def test_connected_components_rounds(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long"), Workspace(spark, "t"), "c").collect()}
    label = {k: k for x in links if x[0] != x[1] for k in x}
    for _ in range(60):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        v = rng.integers(1, 6, rng.integers(3, 60))
        index = fm_index.FMIndex(v, sample=4)
        rows = np.array([[a, b, c] for a in range(2, 7) for b in range(2, 6) for c in range(2, 6)])
        low, high = index.search(rows, np.full(len(rows), 3))
        for p, a, b in zip(rows, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(v) - 2) if (v[i : i + 3] == p).all()]


def hits_by_force(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w = split(text)
    hit, found = set(), set()
    for k, t in items:
        q = split(t)
        for i in range(max(1, len(q) - width + 1) if q else 0):
            p = q[i : i + width]
            for at in range(len(w) - len(p) + 1):
                if w[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_TEXT", 2000)
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 12, 10, 4, 1, 0, 25])] + [(7, None), (8, "Éa b-c, D!")]
    texts = [prose(rng, 40) for _ in range(30)] + [prose(rng, 5) + " " + (items[rng.randrange(3)][1]) + "! " + prose(rng, 6) for _ in range(20)]
    texts += [items[0][1].upper(), " ".join(items[6][1].split()[3:18]), "x éa B c d y", None, "", "!!"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, contamination int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [hits_by_force(t, items) for t in texts]
    for block in (10**6, 20):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        got = decontamination.decontaminate(docs, bench).orderBy("doc_id").collect()
        assert [(r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"]) for r in got] == want
    clean = decontamination.decontaminate(docs, bench, remove=True).orderBy("doc_id").collect()
    for r, t, (n, hit, _) in zip(clean, texts, want):
        assert (r["text"] == t) if not hit else (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower())) == n - hit)
    assert decontamination.decontaminate(frame(spark, EDGES), bench).count() == len(EDGES)


def test_url_cascade(spark):
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    listed = rng.random(5000) < 0.1
    levels = url_cascade.build_levels(a, b, listed)
    assert len(levels) > 1 and (url_cascade.is_listed(levels, a, b) == listed).all()
    urls = ["http://Ads.Example.com/en/x?q", "http://sub.ads.example.com", "nothing", None, "://", "https://ok.example.org/a#b/c"]
    host, path = url_cascade.url_parts(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(host.alias("host"), path.alias("path"))
    assert [tuple(r) for r in df.collect()] == [("ads.example.com", "/en/x"), ("sub.ads.example.com", ""), ("", ""), ("", ""), ("", ""), ("ok.example.org", "/a")]
    keyed = df.withColumn("keys", url_cascade.host_keys(F.col("host")))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    found = url_cascade.any_listed(keyed, "keys", url_cascade.build_cascades(universe, spark.createDataFrame([("ads.example.com",), ("absent.net",)], "key string")))
    assert [r["listed"] for r in found.collect()] == [True, True, False, False, False, False]


def test_byte_bpe():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", " ", "a" * 3000, "日本語😀" * 40, "it's we'll \t\n <|endoftext|>", "x" * 600 + "yz" * 300, "".join(chr(rng.choice([65, 97, 32, 10, 0x3B1, 0x1F600, 0xE9, 48, 39])) for _ in range(3000)), prose(rng, 300)]
    for t in texts:
        ids = bpe.encode([t])[0]
        assert ids == library.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_long_pieces_in_one_row():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(9)
    tokens = [t for t in bpe.ranks if len(t) > 2]
    for n in [2, 3, 7, 30, 200, 513, 3000, 100_000]:
        for _ in range(40 if n < 300 else 2 if n < 10_000 else 1):
            of_tokens = b"".join(rng.choice(tokens) for _ in range(n // 3 + 1))[:n]
            for piece in (of_tokens, rng.choice([b"a", b"ab"]) * (n // 2), bytes(rng.choice(b"abcdefgh") for _ in range(n))):
                if piece and piece not in bpe.ranks:
                    assert list(bpe._long_row(piece)) == library._encode_single_piece(piece)


def test_byte_bpe_documents(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = frame(spark, EDGES)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    want = {(k if t != "NOID" else None): ("" if t == "NULL" else t).encode() for k, t in enumerate(EDGES)}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back} == want


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files(spark, planes):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*EDGES, "é. É. x!.", "<|endoftext|> hi <|startoftext|>.", "it's we'll, x's.", "a\u0085b \x1c d", "Σίσυφος ΣΣ. İstanbul!", "日本語。 ok:", "x́, ́.", "3.5, 7."]
    work = Workspace(spark, "t")
    manifest = token_files.write_token_files(frame(spark, texts), path, 1, work, planes=planes, block=1000)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    start = 0
    order = sorted(range(len(texts)), key=lambda k: -1 if texts[k] == "NOID" else k)
    for r, k in zip(got, order):
        ids = library.encode("" if texts[k] == "NULL" else texts[k], add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (k if texts[k] != "NOID" else None, start, len(ids), ids)
        start += len(ids)
    assert len(got) == len(texts)
    assert token_files.read_token_files(token_files.write_token_files(frame(spark, []), path, 1, Workspace(spark, "t"))).count() == 0


def statistics_by_force(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [None, "", "a b\na b\n\n a b", "x y z x y z x y z x y", "#$ é|é\tü", "a b \x1cc", *[prose(rng, 50) for _ in range(20)], *[" ".join(x + "$$$" for x in prose(rng, 40).split()) for _ in range(5)], *[prose(rng, 30).upper().replace(" ", "!! ") for _ in range(5)], prose(rng, 12) + " " + ("same five words all here " * 9)]
    got = quality_rules.score_quality(spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, quality_rules string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        q = r["quality_rules"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == statistics_by_force(t)
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
    assert all(r["quality_rules"]["kept"] for r in got[6:26]) and not any(r["quality_rules"]["kept"] for r in [*got[:6], *got[26:]])
    assert quality_rules.score_quality(frame(spark, [])).count() == 0 and quality_rules.score_quality(frame(spark, EDGES)).count() == len(EDGES)


def test_quality_rules_em_by_force(spark):
    rows = [([-1, 0, 0, 0, 0, 0, 0, -1], 7), ([0] * 7 + [1], 80), ([0, -1, 0, 0, 0, 0, 0, -1], 9), ([0] * 8, 4)]
    df = spark.createDataFrame([(v,) for v, n in rows for _ in range(n)], "votes array<int>")
    model = quality_rules.fit(df)
    k, a, prior = len(quality_rules.RULES), [quality_rules.BEGIN] * len(quality_rules.RULES), quality_rules.BEGIN
    for _ in range(quality_rules.STEPS):
        p = [1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(v[j] * np.log(a[j] / (1 - a[j])) for j in range(k))))) for v, _ in rows]
        a = [min(quality_rules.HIGHEST, max(quality_rules.LOWEST, (sum(n * {1: q, -1: 1 - q, 0: 0}[v[j]] for (v, n), q in zip(rows, p)) + 1) / (sum(n for v, n in rows if v[j]) + 2))) for j in range(k)]
        prior = min(0.95, max(0.05, (sum(n * q for (_, n), q in zip(rows, p)) + 1) / (sum(n for _, n in rows) + 2)))
    assert model.accuracies == pytest.approx(a) and model.prior == pytest.approx(prior)


def test_license_scan(spark):
    notice, full = license_scan.TEMPLATES["MIT-notice"], license_scan.TEMPLATES["ISC"]
    texts = [f"intro words\n{notice}\nmore", full, full.replace("AUTHOR", "WRITER", 1), "of the in the and the", None, "", f"x {notice.lower()}", *EDGES[3:]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = license_scan.scan_licenses(docs).orderBy("doc_id").collect()
    names = [[m["license"] for m in r["licenses"]] for r in got]
    assert names[:7] == [["MIT-notice"], ["ISC"], ["ISC"], [], [], [], ["MIT-notice"]] and not any(names[7:])
    assert (got[0]["licenses"][0]["first_line"], got[0]["licenses"][0]["dice"]) == (1, 1.0) and 0.9 < got[2]["licenses"][0]["dice"] < 1

    def dice(a, b):
        grams = lambda t: {tuple(x) for x in zip(*(lambda w: (w, w[1:]))(re.findall(r"[a-z0-9]+", t.lower())))}
        return 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))

    assert got[2]["licenses"][0]["dice"] == pytest.approx(dice(texts[2], full))


def test_license_runs_in_lines():
    """Notices within longer lines and unbroken paragraphs, second notices, and many of them."""
    mit, isc = license_scan.TEMPLATES["MIT-notice"], license_scan.TEMPLATES["ISC"]
    far = " ".join(WORDS)
    texts = [f"Copyright 2024 Foo Inc. {mit}", f"{far} {isc} {far}".replace("\n", " "), f"{mit}\n{far}\n{far} {mit} {far}", f"{mit} " * 3000, far]
    raw, offsets = buffers(pa.array(texts, pa.large_string()))
    got = license_scan.Templates(license_scan.TEMPLATES, 0.8).scan(raw, offsets)
    spans = [[(m["license"], m["first_line"], m["last_line"], m["dice"]) for m in ms if m["license"] in ("MIT-notice", "ISC")] for ms in got]
    assert spans[:3] == [[("MIT-notice", 0, 0, 1.0)], [("ISC", 0, 0, 1.0)], [("MIT-notice", 0, 0, 1.0), ("MIT-notice", 2, 2, 1.0)]]
    assert len(spans[3]) == 3000 and not spans[4]


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0", *(f"{x}-header" for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"))])
def test_license_texts(name):
    """Whole texts and standard headers are found under their own name only."""
    text = " ".join(WORDS) + " " + license_scan.TEMPLATES[name] + " " + " ".join(WORDS)
    (got,) = license_scan.Templates(license_scan.TEMPLATES, 0.8).scan(*buffers(pa.array([text], pa.large_string())))
    assert [m["license"] for m in got] == [name] and got[0]["dice"] == 1


def test_string_kernel_by_force():
    from itertools import combinations

    def phi(row):
        out = {}
        for c in combinations(range(len(row)), 3):
            if c[2] - c[0] < toxicity.SPAN:
                key = tuple(int(row[i]) for i in c)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c[2] - c[0] - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    for word in ("idiot", "i.d.i.o.t", "banana", "ßéx", "ab", "zzzzzz"):
        raw = np.frombuffer(word.encode(), np.uint8)
        matrix = toxicity.Units(raw, np.array([0, len(raw)])).rows[0][0]
        want, (code, value) = phi(matrix[0]), toxicity._features(matrix[0])
        s = toxicity.SYMBOLS
        assert {(c // s // s, c // s % s, c % s): pytest.approx(v) for c, v in zip(code.tolist(), value.tolist())} == want
        weight = np.random.default_rng(1).random(s**3).astype(np.float32)
        assert toxicity.unit_scores(matrix, weight, 0.0)[0] == pytest.approx(float(weight[code] @ value), rel=1e-5, abs=1e-6)


def test_toxicity(spark):
    rng = random.Random(9)
    insults = ["vorgash", "plunkwit", "zedrick"]
    make = lambda bad: " ".join([*prose(rng, 30).split(), *([rng.choice(insults)] if bad else []), *prose(rng, 20).split()])
    rows = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    model = toxicity.train([t.encode() for t, _ in rows[:400]], np.array([y for _, y in rows[:400]]))
    score = lambda ts: model.probability(*buffers(pa.array(ts)))
    held = score([t for t, _ in rows[400:]])
    assert (((held >= 0.5) == [y == 1 for _, y in rows[400:]]).mean()) > 0.97
    odd = score(["", " ", prose(rng, 20) + " plun.kwit", "p l u n k w i t", "x" * 50000])
    assert (odd[:2] < 0.5).all() and (odd[2:4] > held[np.array([y for _, y in rows[400:]]) == 0].max()).all()
    got = toxicity.score_toxicity(frame(spark, EDGES), model, into="score")
    assert got.count() == len(EDGES) and got.filter("score < 0 or score > 1 or score is null").count() == 0
    constant = toxicity.train([b"a"], np.array([0]))
    assert constant.probability(*buffers(pa.array(["a", ""]))).max() < 0.5 and toxicity.train([], np.zeros(0, np.int64)).probability(*buffers(pa.array(["a"]))).shape == (1,)


def test_factorisation_identity_and_learning(spark):
    rng = np.random.default_rng(3)
    texts = ["a b c a", "", "!! ?? $$", "line\nline\nother x"]
    raw, offsets = buffers(pa.array(texts))
    f, v, b = quality_fm.features(raw, offsets)
    model = quality_fm.FactorisationMachine(0.3, rng.normal(size=quality_fm.N_FEATURES), rng.normal(size=(quality_fm.N_FEATURES, quality_fm.FACTORS)))
    for k, got in enumerate(model.margins(f, v, b)):
        x, y = f[b[k] : b[k + 1]], v[b[k] : b[k + 1]]
        pairs = sum(float(model.factors[x[i]] @ model.factors[x[j]]) * y[i] * y[j] for i in range(len(x)) for j in range(i))
        assert got == pytest.approx(model.bias + float(model.linear[x] @ y) + pairs)
    draw = random.Random(4)
    rows = [(prose(draw, 40) if k % 3 else prose(draw, 40).upper().replace(" ", "!! "), int(k % 3 > 0)) for k in range(300)]
    trained = quality_fm.train([t.encode() for t, _ in rows[:200]], np.array([y for _, y in rows[:200]]))
    held = trained.probability(*buffers(pa.array([t for t, _ in rows[200:]])))
    assert ((held >= 0.3) == [y == 1 for _, y in rows[200:]]).mean() > 0.95
    got = quality_fm.score_quality(frame(spark, EDGES), trained, into="score")
    assert got.count() == len(EDGES) and got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_exchange_clustering():
    pairs = np.zeros((8, 8), dtype=np.int64)
    pairs[:4, 4:], pairs[4:, :4] = 50, 40
    pairs += np.random.default_rng(2).integers(0, 9, (8, 8))
    got = brown_lm.exchange(pairs, pairs.sum(axis=0), classes=2)
    assert len(set(got[:4])) == 1 and len(set(got[4:])) == 1 and got[0] != got[4]


def test_exchange_gains_by_force():
    """Gains of all words, sparse and together, against the information of each class bigram table."""
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 4, (12, 12)) * (rng.random((12, 12)) < 0.4)
    of = rng.integers(0, 3, 12)
    of[7] = brown_lm.NO_CLASS

    def table(of):
        out = np.zeros((3, 3))
        for a in range(12):
            for b in range(12):
                if brown_lm.NO_CLASS not in (of[a], of[b]):
                    out[of[a], of[b]] += pairs[a, b]
        return out

    def total(t):
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(axis=1)) - f(t.sum(axis=0))

    own = np.where(of == brown_lm.NO_CLASS, 0, np.diagonal(pairs)).astype(float)
    into, out = (np.array([[sum(m[v, w] for v in range(12) if of[v] == c and v != w) for c in range(3)] for w in range(12)], dtype=float) for m in (pairs, pairs.T))
    got = brown_lm.gains(table(of), of, into, out, own)
    for w in range(12):
        tables = []
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            t = table(moved)
            t[c, c] -= pairs[w, w] if of[w] == brown_lm.NO_CLASS else 0  # not counted before it has a class
            tables.append(total(t))
        assert got[w] - got[w, 0] == pytest.approx(np.array(tables) - tables[0], abs=1e-6)


def test_all_words_move_by_corpus_counts(spark, monkeypatch):
    """Words far from the head find the class of words used alike, however the rows fall into chunks."""
    monkeypatch.setattr(brown_lm, "HEAD", 2)
    rng = random.Random(7)
    kinds = [[f"{k}{i}" for i in range(20)] for k in "abc"]
    # The head is h and the end, whose neighbours tell nothing of the kinds; all else is outside it.
    texts = [" ".join(["h", *(rng.choice(kinds[(i + k) % 3]) for i in range(60)), "h"]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    each = []
    for chunk, part in ((12 << 20, 10**6), (300, 30)):
        monkeypatch.setattr(brown_lm, "CHUNK", chunk)
        monkeypatch.setattr(brown_lm, "PART", part)
        got = [r for r in brown_lm.score_texts(docs, F.col("doc_id") % 5 != 0).collect() if r["held_out"]]
        each.append(sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got))
    assert each[0] == pytest.approx(each[1])
    # The unigram has log10(1 / 60) a word, about; moving by the head alone gave -1.72.
    assert each[0] > -1.66


@pytest.mark.parametrize("chunk", [12 << 20, 300])
def test_language_model(spark, monkeypatch, chunk):
    from collections import Counter
    from math import log10

    monkeypatch.setattr(brown_lm, "CHUNK", chunk)
    monkeypatch.setattr(brown_lm, "PART", 50 if chunk == 300 else 10**6)
    rng = random.Random(11)
    texts = [None, "", " ", *[prose(rng, 30) for _ in range(40)], "quite unknown words", "BAD bad Bad"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taught = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    got = {r["doc_id"]: r for r in brown_lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()}
    words = {k: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    c = Counter(w for k, ws in words.items() if taught(k) for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in words.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not taught(k), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
    assert brown_lm.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert brown_lm.score_texts(docs, F.lit(False)).count() == len(texts)


def test_language_model_by_force(spark, monkeypatch):
    """Scores by the formula from the classes found; probabilities add up to one; equal texts score alike however rows are dealt."""
    from collections import Counter
    from math import log10

    made = []
    monkeypatch.setattr(brown_lm, "Workspace", type("Kept", (Workspace,), {"__init__": lambda self, *a: (Workspace.__init__(self, *a), made.append(self))[0], "drop": lambda self, *names: None}))
    monkeypatch.setattr(brown_lm, "HEAD", 10)
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([0, 1, 2, 9, 25])) + rng.choice(["", " unseen" + str(k)]) for k in range(120)] + ["ba be w1"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    for dealt, chunk in ((1, 1 << 20), (4, 400), (9, 50)):
        monkeypatch.setattr(brown_lm, "CHUNK", chunk)
        scores.append({r["doc_id"]: r["score"] for r in brown_lm.score_texts(docs.repartition(dealt), F.col("doc_id") % 3 != 0).collect()})
    for other in scores[1:]:
        assert [other[k] for k in range(len(texts))] == pytest.approx([scores[0][k] for k in range(len(texts))])
    assert len({round(scores[0][k], 9) for k, t in enumerate(texts) if t == "ba be w1"}) == 1

    words = [[*t.split(), "\n"] for t in texts]
    c = Counter(w for k, ws in enumerate(words) if k % 3 for w in ws)
    n, v, size = sum(c.values()), len(c), brown_lm.CLASSES
    names = {int(word_hash(w.encode())): w for w in c}
    root = made[0].root.removeprefix("file://")
    last = max(int(x.name.removeprefix("classed")) for x in Path(root).glob("classed*"))
    candidates = []
    for step in (last, last - 1):  # the last step is taken back if it lost
        of = {}
        for r in spark.read.parquet(f"{root}/classed{step}").collect():
            of |= {names[int(h)]: int(k) for h, k in zip(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["kinds"], np.uint8)) if int(h) in names}
        cube, sizes = np.zeros((size,) * 3), Counter()
        for w in c:
            sizes[of[w]] += c[w]
        walks = []
        for k, ws in enumerate(words):
            past, walk = [of["\n"]] * 2, []
            for w in ws:
                walk.append((past[-2], past[-1], w))
                if w in c:
                    cube[past[-2], past[-1], of[w]] += bool(k % 3)
                    past.append(of[w])
            walks.append(walk)
        single = (cube.sum(axis=(0, 1)) + 1e-3) / (cube.sum() + 1e-3 * size)
        two = (cube.sum(axis=0) + 5 * single) / (cube.sum(axis=0).sum(axis=1, keepdims=True) + 5)
        three = (cube + 10 * two[None]) / (cube.sum(axis=2, keepdims=True) + 10)
        u = 1 / (n + v + 1)

        def p(a, b, w):
            if w not in c:
                return u
            g = of[w]
            mixed = brown_lm.L3 * three[a, b, g] + brown_lm.L2 * two[b, g] + brown_lm.L1 * single[g]
            return (1 - u) * mixed * c[w] / sizes[g] + brown_lm.L0 * (c[w] + 1) * u

        candidates.append([sum(log10(p(*x)) for x in walk) for walk in walks])
        assert sum(p(of["ba" + "d"], of["\n"], w) for w in c) + u == pytest.approx(1, abs=1e-3)
    assert any([scores[0][k] for k in range(len(texts))] == pytest.approx(x) for x in candidates)


def test_first_order_gains():
    """For words whose counts are small beside the table's, the first order agrees with the gains in full."""
    rng = np.random.default_rng(5)
    table = rng.integers(20_000, 90_000, (6, 6)).astype(float)
    into, out, own = rng.integers(0, 3, (9, 6)).astype(float), rng.integers(0, 3, (9, 6)).astype(float), np.zeros(9)
    here = np.full(9, brown_lm.NO_CLASS)
    full, first = brown_lm.gains(table, here, into, out, own), brown_lm.first_order(table, into, out, own)
    assert np.allclose(full - full[:, :1], first - first[:, :1], atol=5e-3)


def test_query_digests(spark):
    from plumbline.llm.q_byte_bpe import digests

    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n, ids, back = (x.to_pylist() for x in digests(bpe.encode(["ab cd"]), bpe))
    assert ids == [hashlib.sha256(",".join(map(str, bpe.encode(["ab cd"])[0])).encode()).hexdigest()] and back == [hashlib.sha256(b"ab cd").hexdigest()] and n == [len(bpe.encode(["ab cd"])[0])]


def test_shared_folder():
    """A folder of this machine is made only where the master is local; a cluster has to name one."""
    from types import SimpleNamespace as Of

    from plumbline.llm._shared import shared_dir

    def session(master, path=None):
        none = Of(isDefined=lambda: False)
        return Of(conf=Of(get=lambda *a: path), sparkContext=Of(master=master, setCheckpointDir=lambda p: None, _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: none))))

    for master in ("local", "local[8]", "local[*]"):
        assert shared_dir(session(master)).startswith("file:///")
    for master in ("yarn", "spark://x:1", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
