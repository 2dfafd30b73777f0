"""Near-duplicates, repeated passages, vectors and benchmark windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessel.llm import decontam, minhash, phrases, vectors
from tessel.llm import text as tx
from tessel.llm.graph import components

WORDS = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "ba de fi go hu ja ke li".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(40, 160))) for i in range(40)]
    base = prose(rng, 200)
    for i in range(40, 75):  # a group of near copies, not all near each other
        words = base.split()
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    passage = prose(rng, 50)
    rows += [(i, f"{prose(rng, 30)}\n{passage}\t{prose(rng, 30)}") for i in range(75, 85)]
    rows += [(90, rows[0][1]), (91, rows[0][1].upper()), (92, None), (93, ""), (94, " \n"), (95, "one"), (96, "ONE"), (97, "one two"), (98, "spam " * 300), (99, "spam " * 300 + "ham"), (99, "spam " * 300 + "ham")]
    rows += [(None, rows[1][1]), (100, "é\u00a0x\x1cy \x0b tail " * 20), (101, f"{passage} {passage}")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t, i, "x", "y") for i, t in corpus()], "text string, doc_id long, id string, row string").repartition(3).persist()


def roots(links, ids):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500)] + [(300, i) for i in range(301, 360)]
    ids = {x for p in links for x in p if p[0] != p[1]}
    found = {r.id: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == roots([p for p in links if p[0] != p[1]], ids)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, size, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    known = [(i, s) for i, s in rows if i is not None and s]
    links = [(a, b) for x, (a, s) in enumerate(known) for b, t in known[:x] if 100 * len(s & t) >= percent * len(s | t)]
    root = roots(links, {i for i, _ in rows if i is not None})
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.report(docs, size, percent).collect()), key=repr)
    assert found == sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in rows), key=repr)


def test_minhash_keeps_one_of_each_group(spark, docs):
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {0, 92, 93, 94, 95, None} <= left and not {90, 91, 96} & left
    assert minhash.report(docs.limit(0)).count() == 0


def test_minhash_keeps_one_of_rows_with_repeated_or_null_ids(spark):
    rng = random.Random(7)
    same, nulls, own, other = (prose(rng, 60) for _ in range(4))
    rows = [(1, same), (1, same), (2, same), (None, nulls), (None, nulls), (None, nulls + " more"), (3, own), (3, other), (4, None), (4, None), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(map(tuple, minhash.deduplicate(docs.persist()).collect()), key=repr)
    assert [r for r in left if r[1] and r[1].startswith(nulls)][1:] == []
    assert sorted([r for r in left if not (r[1] and r[1].startswith(nulls))], key=repr) == sorted([(1, same), (3, own), (3, other), (4, None), (4, None), (None, ""), (None, "")], key=repr)
    assert len(left) == 8


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    for share in (0.7, 0.8, 0.9, 0.97):
        n = 2000
        same, own = rng.integers(0, 1 << 63, int(n * 2 * share / (1 + share)), dtype=np.uint64), [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([same, o[: n - len(same)]])) for o in own]
        *_, sketch = minhash.sign(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        got = minhash.estimate(np.bitwise_count(sketch[0] ^ sketch[1]).sum().astype(float))
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(got - true) < minhash.MARGIN


def test_phrases(docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    expected = []
    for i, w in rows:
        on = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                on[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, o in zip(w, on, strict=True) if not o)
        expected.append((i, len(w), sum(on), hashlib.sha256(kept).hexdigest()))
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.report(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(n for _, _, n, _ in expected) > 1000
    assert phrases.report(docs.limit(0)).count() == 0


LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_decontamination(spark, docs, block_words):
    texts = corpus()
    item = lambda i, a, b: " ".join((texts[i][1]).split()[a:b])
    items = [(1, item(2, 5, 40)), (2, item(3, 10, 22)), (3, item(4, 10, 15).upper()), (4, "one"), (5, ""), (6, None), (10, item(2, 5, 40)), (None, item(5, 0, 20)), (7, "not there at all"), (4, "one")]
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    expected = []
    for i, t in ((r.doc_id, r.text) for r in docs.collect()):
        w = ALNUM.findall((t or "").translate(LOW))
        on, own = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    own |= windows[tuple(w[k : k + n])]
                    on[k : k + n] = [True] * n
        expected.append((i, len(w), sum(on), sorted(str(x) for x in own if x is not None)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.find(docs, bench, block_words=block_words).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(n > 0 for _, _, n, _ in expected) >= 5
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_decontamination_removes_by_text(spark, block_words):
    rng = random.Random(6)
    one, two, clean = prose(rng, 20), prose(rng, 20), prose(rng, 40)
    rows = [(1, f"{prose(rng, 5)} {one}"), (1, clean), (None, two), (None, clean), (2, clean), (3, None), (None, None), (4, one), (4, one), (None, "")]
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(map(tuple, decontam.remove(docs.persist(), bench, block_words).collect()), key=repr)
    assert left == sorted([(1, clean), (None, clean), (2, clean), (3, None), (None, None), (None, "")], key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        centres = rng.standard_normal((60, 16))
        for i, c in enumerate(centres):
            for k in range(1 + (i % 4 == 0) * 5):
                rows.append((len(rows), (c + 0.12 * k * rng.standard_normal(16)).astype(np.float32).tolist(), label))
    rows += [(len(rows) + i, rows[3][1], 0) for i in range(5)]
    n = len(rows)
    odd = [(n, rows[3][1], None), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [float("inf")] * 16, 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [], 0)]
    table = spark.createDataFrame([(*r, "z") for r in rows + odd + [(None, rows[3][1], 0)]], "vec_id long, embedding array<float>, label int, v string")
    links = []
    good = rows + odd[6:8]
    for a, (i, v, k) in enumerate(good):
        for j, w, m in good[:a]:
            if k == m and len(v) == len(w):
                x, y = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((i, j))
    count = Counter(x for p in links for x in p)
    root = roots(links, range(n + 9))
    found = {r.vec_id: r for r in vectors.report(table).collect()}
    assert len(found) == n + 10
    assert all(found[i].n_links <= count[i] for i in range(n + 9))
    assert sum(found[i].n_links for i in range(n + 9)) >= 0.9 * sum(count.values())
    assert sum(found[i].component_id == root[i] for i in range(n + 9)) >= 0.95 * (n + 9)
    assert all(found[i].kept == (found[i].component_id == i) for i in range(n + 9)) and found[None].component_id is None
    assert vectors.report(table.limit(0)).count() == 0


def test_vectors_keep_a_dense_group_whole(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = unit(unit(rng.standard_normal(64)) + 0.224 * unit(rng.standard_normal((4000, 64))))
    m = np.concatenate([group, unit(rng.standard_normal((8000, 64)))]).astype(np.float32)
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>, label int")
    own = m[:4000].astype(np.float64)
    count = (vectors.cosine(own, own) >= 0.93).sum(axis=1) - 1
    found = {r.vec_id: r for r in vectors.report(table).collect()}
    got = np.array([found[i].n_links for i in range(4000)])
    assert len(found) == 12000 and count.mean() > 3900
    assert (got <= count).all() and got.sum() >= 0.95 * count.sum()


def test_trees_are_added_until_a_loose_group_is_linked(spark):
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = unit(unit(rng.standard_normal(32)) * 0.93 + 0.42 * unit(rng.standard_normal((6000, 32))))
    m = np.concatenate([group, unit(rng.standard_normal((6000, 32)))])
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>, label int")
    near = np.triu(vectors.cosine(m[:6000], m[:6000]) >= 0.93, 1)
    x, y = np.nonzero(near)
    assert 100 < len(x) < 6000 * 6000 / 2 / 1024
    got = sum(r.n_links for r in vectors.report(table).select("n_links").collect())
    assert 0.97 * 2 * len(x) <= got <= 2 * len(x)
    labels = np.zeros(len(m), dtype=np.int64)
    known = (m[x[::7]], m[y[::7]], labels[x[::7]])
    grown = vectors.forest(m, labels, 100, 0.93, known)
    parts = [[set() for _ in m] for _ in grown]
    for tree, (own, part) in enumerate(zip(grown, parts, strict=True)):
        for row, leaf in zip(*vectors.leaves(m, labels, tree, *own), strict=True):
            part[row].add(leaf)
        met = vectors.meets(*known, tree, *own)
        assert met.tolist() == [not part[a].isdisjoint(part[b]) for a, b in zip(x[::7], y[::7], strict=True)]


def test_word_hashes_tell_words_apart():
    raw = np.frombuffer(b"abc abd abc  a", dtype=np.uint8)
    block = tx.Block(raw, np.array([0, 7, 7, 14]), tx.NOT_SPACE, False)
    h = block.hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 3 and block.first.tolist() == [0, 2, 2, 4]
    joined = tx.Block(np.frombuffer(b"abcd", dtype=np.uint8), np.array([0, 2, 4]), tx.NOT_SPACE, False)
    assert joined.words(0) == [b"ab"] and joined.words(1) == [b"cd"]
    words = [b"a", b"eightlet", b"ninelette", b"x" * 300, b"x" * 301, b"eightlet\x00"]
    assert len(set(tx.hashed(words).tolist())) == 6
    assert tx.run_hashes(tx.hashed(words), 6).shape == (1,) and not len(tx.run_hashes(tx.hashed(words), 7))
    twice = tx.hashed(words * 2)
    for size in range(1, 7):
        runs = tx.run_hashes(twice, size)
        assert (runs[: 7 - size] == runs[6 : 13 - size]).all() and len(set(runs.tolist())) == 6


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_phrases_tell_thue_morse_texts_apart(spark):
    texts = [" ".join(thue_morse(4096, *pair) + [f"w{i}" for i in range(4096)]) for pair in (("foo", "bar"), ("bar", "foo"))]
    # inside one text runs of such a pattern recur; the texts as wholes don't
    rows = spark.createDataFrame([(i, " ".join(f"{x}{k}" for k, x in enumerate(t.split()[:4096]))) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.n_removed for r in phrases.report(rows).collect()] == [0, 0]
    half = [" ".join(f"{x} {y}" for x, y in zip(t.split()[:4096], t.split()[4096:], strict=True)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(half)), "doc_id long, text string")
    assert [r.n_removed for r in phrases.report(rows).collect()] == [0, 0]


def test_texts_without_white_space_and_very_long_ones(spark):
    rng = random.Random(4)
    words = prose(rng, 200_000).split()
    long = " ".join(words)
    words[100_000] = "other"
    rows = [(1, long), (2, " ".join(words)), (3, "x" * 2_000_000), (4, "x" * 1_999_999 + "y"), (5, prose(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    assert [tuple(r) for r in minhash.report(docs).orderBy("doc_id").select("doc_id", "component_id").collect()] == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert [r.n_removed for r in phrases.report(docs).orderBy("doc_id").collect()] == [199_999, 199_999, 0, 0, 0]
    bench = spark.createDataFrame([(1, " ".join(words[50_000:50_020])), (2, "x" * 2_000_000)], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in decontam.find(docs, bench).orderBy("doc_id").collect()] == [(20, ["1"]), (20, ["1"]), (1, ["2"]), (0, []), (0, [])]
