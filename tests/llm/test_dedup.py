"""Suffix dedup (8), embeddings (9), n-gram join (10), components and the pipeline, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tests.llm.cases import awkward, docs, sentence

import corpus_pipeline
from tidemark.llm import embedding_dedup, graph, hashing, ngram_join, suffix_dedup
from tidemark.llm.oracles import ORACLE_SQL
from tidemark.llm.queries import QUERIES


class Union:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def test_rolling_hashes_depend_on_the_bytes_only():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    rolling = hashing.Rolling(1)
    sums = rolling.prefixes(data)
    windows = rolling.windows(sums, 7)
    by_bytes = defaultdict(set)
    for k, h in enumerate(windows.tolist()):
        by_bytes[data[k : k + 7].tobytes()].add(h)
    assert all(len(v) == 1 for v in by_bytes.values()) and len({next(iter(v)) for v in by_bytes.values()}) == len(by_bytes)
    other = hashing.Rolling(1)
    assert (other.windows(other.prefixes(data[100:]), 7) == windows[100:]).all()
    starts = np.arange(2900)
    assert len(set(rolling.stretches(sums, starts, starts + 40).tolist())) > 2800


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(29, 100), (100, 99)], [(k, (k * 7) % 50) for k in range(50)]])
def test_components(spark, links):
    nodes = {x for link in links for x in link if link[0] != link[1]}
    union = Union(nodes)
    for a, b in links:
        if a != b:
            union.join(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, graph.components(df).collect())) == sorted((x, union.root(x)) for x in nodes)
    assert sorted(map(tuple, graph.components(graph.forest(df)).collect())) == sorted((x, union.root(x)) for x in nodes)


def slow_repeats(texts, length=400):
    """Runs of each text that repeated strings cover, by counting every string of a length."""
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append([(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))])
    return out


def repeat_texts():
    rng = random.Random(8)
    passage, other = sentence(rng, 90), sentence(rng, 120, "xyz")
    plain = [sentence(rng, 200) for _ in range(6)]
    edited = plain[0][:700] + "#" + plain[0][701:]
    return [
        *plain, plain[1], edited, plain[2][:300] + passage + plain[3][:50], passage + plain[4][100:300], "x" + passage[5:], other * 4, "z" * 1500, "z" * 399, "z" * 400, "ab" * 700, ("ab" * 300) + "c" + ("ab" * 300), "é" + other[:390] + "è", passage[:399], passage[1:400], "", None,
        (passage + " " + other) * 2 + plain[5][:600], "é" * 250 + "!", "ê" + "é" * 260, sentence(rng, 30) + " " + other[100:390], other[100:390] + sentence(rng, 40), thue_morse(9), thue_morse(9).translate(SWAP),
    ]


SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    """2**n letters; they and their opposite collide under any polynomial hash modulo a power of two, if n is large."""
    return "".join("ab"[k.bit_count() % 2] for k in range(1 << n))


@pytest.mark.parametrize("copies,most", [(1, 1 << 16), (3, 1), (1, 2)])
def test_suffix_dedup(spark, monkeypatch, copies, most):
    """With all trigger strings sorted, with all beyond the bound of classes, and with some halves sorted."""
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", most)
    texts = [t for t in repeat_texts() for _ in range(copies if t and t.startswith("z") else 1)]
    raw = [(t or "").encode() for t in texts]
    want, short = slow_repeats(raw), slow_repeats(raw, 200)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs(spark, texts, extra=True).repartition(3)).collect()}
    assert len(got) == len(texts)
    for k, (b, spans) in enumerate(zip(raw, want, strict=True)):
        kept = b"".join(b[i:j] for i, j in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), k
        assert [(x.start, x.end) for x in r.spans or []] == spans
        passages = [(i, j) for i, j in short[k] if len(b[i:j].split()) > 50]
        assert ([(x.start, x.end) for x in r.passages or []], r.passage_bytes) == (passages, sum(j - i for i, j in passages)), k


def test_shared_places_against_brute_force():
    rng = random.Random(6)
    shape = suffix_dedup.Shape(length=20, spread=9)
    for _ in range(200):
        n = rng.randrange(2, 12)
        some = lambda: bytes(rng.choice(b"\0a") for _ in range(rng.choice([8, 8, 8, 5, 0])))
        group, before, behind = np.sort(np.array([rng.randrange(3) for _ in range(n)])), [some() for _ in range(n)], [some() for _ in range(n)]
        strings = [[(g, a[:j], b[: 8 - j]) if len(a) >= j and len(b) >= 8 - j else None for g, a, b in zip(group.tolist(), before, behind, strict=True)] for j in range(9)]
        want = [[x is not None and row.count(x) > 1 for x in row] for row in strings]
        assert suffix_dedup.shared_places(shape, group, before, behind).tolist() == want


@pytest.mark.parametrize("most", [1, 4])
def test_masks_by_halves_are_those_of_sorting(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", most)
    rng = random.Random(most)
    for spread in (9, 16):
        shape = suffix_dedup.Shape(length=20, spread=spread)
        some = lambda: bytes(rng.choice(b"\0aa") for _ in range(rng.choice([spread - 1] * 3 + [spread // 2, 0])))  # noqa: B023, E731
        rows = sorted((rng.randrange(3), some(), some(), k, -k, 7) for k in range(120))
        want = suffix_dedup.shared_places(shape, *(f(list(c)) for f, c in zip((np.array, list, list), list(zip(*rows, strict=True))[:3], strict=True)))
        got = np.zeros_like(want)
        place = {r[3:]: k for k, r in enumerate(rows)}
        for part in suffix_dedup.masks_by_halves(shape, spark.createDataFrame(rows, suffix_dedup._CONTEXT_SQL).repartition(3)):
            for r in part.collect():
                got[:, place[r.s1, r.s2, r.at]] |= np.unpackbits(np.frombuffer(r.mask, np.uint8))[:spread].astype(bool)
        assert got.tolist() == want.tolist()
        assert want.any()


def test_passages_are_cut_by_their_words(spark):
    rng = random.Random(3)
    passage, line = " ".join(rng.choice(["ab", "cde", "fghi"]) for _ in range(60)), " ".join("license" + str(k) for k in range(30))
    texts = [" ".join([sentence(rng, 60), part, sentence(rng, 60)]) for part in (passage, passage, line, line, "nothing")]
    left = {r.doc_id: r.text for r in suffix_dedup.cleaned(docs(spark, texts), 200, 50).collect()}
    assert len(passage) < 400 and [passage in left[k] for k in range(2)] == [False, False] and all(left[k] == texts[k] for k in (2, 3, 4))
    assert all(len(left[k]) >= len(texts[k]) - len(passage) - 40 for k in range(2))


def test_suffix_dedup_awkward_and_cleaned(spark):
    rows = [(d, t) for d, t in awkward() if d != 9] + [(40 + k, t) for k, t in enumerate(repeat_texts())]
    raw = [(t or "").encode() for _, t in rows]
    want = slow_repeats(raw)
    df = docs(spark, rows, extra=True)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).collect()), key=repr)
    assert got == sorted(((d, len(b), sum(e - s for s, e in spans)) for (d, _), b, spans in zip(rows, raw, want, strict=True)), key=repr)
    clean = suffix_dedup.cleaned(df)
    assert clean.columns == df.columns
    left = []
    for (d, t), b, spans in zip(rows, raw, want, strict=True):
        kept = b"".join(b[i:j] for i, j in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
        if not spans:
            left.append((d, t))
        elif kept:
            left.append((d, kept.decode("utf-8", "ignore")))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(left, key=repr)
    none = docs(spark, []).limit(0)
    assert suffix_dedup.dedup(none).count() == 0 and suffix_dedup.cleaned(none).count() == 0


def test_triggers_are_in_every_string_at_equal_places():
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 4, 3000).astype(np.uint8), np.zeros(900, np.uint8), np.tile(rng.integers(0, 9, 50).astype(np.uint8), 30)):
        for shape in (suffix_dedup.Shape(), suffix_dedup.Shape(200)):
            at = suffix_dedup.Parse(shape, data, np.array([0, len(data)])).at
            assert at[0] < shape.spread and (np.diff(at) <= shape.spread).all() and len(data) - shape.trigger - at[-1] < shape.spread
            part = data[100:850]
            inner = suffix_dedup.Parse(shape, part, np.array([0, len(part)])).at
            safe = (inner >= 0) & (inner <= len(part) - shape.trigger)
            assert set((inner[safe] + 100).tolist()) <= set(at.tolist()) | set((inner[(inner < shape.spread) | (inner > len(part) - shape.length)] + 100).tolist())


def slow_sets(rows):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.setdefault(d, []).append(frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) > 3 else frozenset([tuple(w)] if w else []))
    return out


def slow_components(rows):
    sets = slow_sets(rows)
    union = Union([d for d in sets if d is not None])
    flat = [(d, s) for d, ss in sets.items() for s in ss if d is not None and s]
    for k, (a, s) in enumerate(flat):
        for b, t in flat[:k]:
            if 100 * len(s & t) >= 85 * len(s | t):
                union.join(a, b)
    return {d: union.root(d) for d in union.parent}


def near_copies():
    rng = random.Random(11)
    vocabulary = [sentence(rng, 1) + str(k) for k in range(4000)]
    rows = []
    for size in (60, 150, 30):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 40]))) for _ in range(40)]
    rows += ["A b C d", "a B c D", "a b c", "A\tb\nc", "a", "a", "", None, "b"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hot,block", [(48, 512), (3, 7), (2, 1000)])
def test_ngram_join(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    want, sets = slow_components(rows), slow_sets(rows)
    got = ngram_join.join(docs(spark, rows, extra=True).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(sets[d][0]), want[d]) for d, _ in rows)
    assert len(set(want.values())) < len(rows) - 60


def test_ngram_join_links_no_words_that_differ_by_a_pattern(spark):
    """Thue-Morse words and their opposites collide under polynomial hashes modulo a power of two, of any odd base."""
    words = [x for n in (10, 11, 4) for x in (thue_morse(n), thue_morse(n).translate(SWAP))]
    rows = list(enumerate([*words, *("one two three " + w for w in words), *(f"a b {w} c d" for w in words), words[0] + " "]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, rows)).collect()}
    assert got == {d: (2 if 12 <= d < 18 else 1, 0 if d == 18 else d) for d, _ in rows}


def test_ngram_join_awkward(spark):
    rows = awkward()
    want, sets = slow_components(rows), slow_sets(rows)
    got = ngram_join.join(docs(spark, rows, extra=True)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(s), want.get(d)) for d, ss in sets.items() for s in ss)
    assert ngram_join.join(docs(spark, []).limit(0)).count() == 0


def vectors(n=260, d=24, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for size in (60, 25, 8, 2):
        base = rng.normal(size=d)
        out += [base + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.2]) for _ in range(size)]
    out += [rng.normal(size=d) for _ in range(n - len(out))]
    return [[float(x) for x in v] for v in out]


def slow_links(rows, threshold):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and None not in v and np.isfinite([float(x) for x in v]).all() and any(v)]
    union, links = Union([k for k, _ in rows if k is not None]), Counter()
    for k, (a, x) in enumerate(good):
        for b, y in good[:k]:
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                union.join(a, b)
                links[a] += 1
                links[b] += 1
    return {k: (links[k], union.root(k), union.root(k) == k) for k in union.parent}


@pytest.mark.parametrize("block", [512, 9])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    v = vectors()
    rows = [*enumerate(v), *((1000 + k, v[k % 3]) for k in range(12)), (2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] + v[0][1:]), (2005, v[0][:20]), (2006, [3 * x for x in v[5]]), (2007, [float("inf")] * 24), (2008, [1.0]), (2009, [2.0]), (2010, [-1.0])]
    df = spark.createDataFrame([(k, x, 1) for k, x in rows], "vec_id long, embedding array<float>, label int")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df.repartition(3)).collect()}
    want = slow_links(exact, 0.95)
    assert len(got) == len(rows)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert 0.99 * there <= found <= there  # measured recall; no link below the threshold
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
    assert all(got[k] == (0, k, True) for k in (2000, 2001, 2002, 2003, 2004, 2007, 2010)) and got[2009] == (1, 2008, False)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids(spark):
    """Every row is looked at: equal rows are one vector, another vector of the same id is one of its own."""
    v = vectors(12, 24, 5)
    near = [x * 1.0001 for x in v[0][:-1]] + [v[0][-1] * 0.999]
    rows = [(1, v[0]), (1, v[0]), (1, v[0]), (2, v[0]), (3, near), (3, v[100 % 12]), (4, v[11]), (4, v[11]), (5, None), (5, None), (5, near), (None, v[0]), (None, None), (6, [-x for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df.repartition(3)).collect())
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    nodes = sorted({(k, tuple(x)) for k, x in rows if k is not None and x})
    linked = {a: [b for b in nodes if b != a and unit(a[1]) @ unit(b[1]) >= 0.95] for a in nodes}
    union = Union(nodes)
    for a, others in linked.items():
        for b in others:
            union.join(a, b)
    want = Counter()
    for k, x in rows:
        if k is None or not x:
            want[k, 0, k, k is not None] += 1
        else:
            c = min(n[0] for n in nodes if union.root(n) == union.root((k, tuple(x))))
            want[k, len(linked[k, tuple(x)]), c, c == k] += 1
    assert got == want


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(4).normal(size=(5, 16))
    y = embedding_dedup.hadamard(x) / 4
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(embedding_dedup.hadamard(y) / 4, x)
    keys = embedding_dedup.bucket_keys(x)
    assert (keys == embedding_dedup.bucket_keys(x * 7)).all() and keys.shape == (5, embedding_dedup.TABLES * embedding_dedup.PROBES)


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    passage = sentence(rng, 110)
    texts, langs = [], []
    for k in range(60):
        texts.append(sentence(rng, 60, "abc" if k % 2 else "xyz") + f" u{k}")
        langs.append("en" if k % 2 else "fr")
    texts += [texts[0], texts[1] + " tail", "### 123", None, passage + " " + sentence(rng, 200), sentence(rng, 200) + " " + passage, 'mail token = "abcDEF0123456789xyz" ' + sentence(rng, 40)]
    langs += ["fr", "en", "en", None, "en", "en", "en"]
    folder = f"{tmp_path}/sf"
    docs(spark, texts, langs=langs).write.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stages["language_id"](spark, df, folder)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(67)) - {62, 63}
    kept = stages["ngram_join"](spark, kept, folder)
    assert {r.doc_id for r in kept.collect()} == set(range(67)) - {60, 61, 62, 63}
    kept = stages["suffix_dedup"](spark, kept, folder)
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == set(range(67)) - {60, 61, 62, 63} and kept.columns == df.columns
    assert all(passage not in rows[d].text and rows[d].n_chars == len(rows[d].text) for d in (64, 65)) and rows[5].text == texts[5]
    kept = stages["secret_scan"](spark, kept, folder)
    rows = {r.doc_id: r for r in kept.collect()}
    assert "abcDEF" not in rows[66].text and rows[66].text.startswith("mail token") and rows[7].text == texts[7]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "secret_scan", "best_fit_packing"]


def test_pipeline_links_five_word_shingles_from_four_fifths(spark):
    rows = []
    for n in (50, 49, 48):  # similarity 41/51, 40/50 and 39/49; by four words all are under 0.85
        words = [f"w{n}x{k}" for k in range(n)]
        rows += [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    for df in (docs(spark, awkward(), extra=True), docs(spark, []).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            rows = out.collect()
            if name != "best_fit_packing":
                assert out.columns == df.columns
            if name == "ngram_join" and rows:
                ids = [r.doc_id for r in rows]
                assert ids.count(7) == 0 and ids.count(6) == 1 and ids.count(None) == 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_return_the_columns_and_rows_of_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
