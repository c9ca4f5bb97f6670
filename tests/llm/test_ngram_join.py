"""Jaccard links and components against all pairs."""

import random

import numpy as np
import pytest

from textlab.llm import common
from textlab.llm import ngram_join as nj


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k=4, num=85, den=100):
    sets, parent = sets_of([t for _, t in rows], k), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def compare(spark, rows, **how):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(df, **how).collect())
    assert got == brute(rows, **how)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=14))
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(20)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:  # near copies, from far inside to just outside the threshold
            w = rng.choice(base[:8] if kind < 0.4 else base).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.8:  # a common line and little else
            texts.append(line + " " + " ".join(rng.choices(words, k=rng.randint(0, 30))))
        elif kind < 0.9:
            texts.append(" ".join(rng.choices(words, k=rng.randint(0, 6))))
        else:
            texts.append(rng.choice(texts or ["x"]).upper() + "\t")
    ids = list(range(10, 10 + n))
    rng.shuffle(ids)
    return list(zip(ids, [*texts[:-3], None, "", " \n "]))


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    compare(spark, corpus(seed))


def test_blocks_and_leaves_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(nj, "LEAF", 3)
    compare(spark, corpus(7))


@pytest.mark.parametrize("part", [1_000_000, 7, 40])
def test_components_in_parts_of_any_size(spark, monkeypatch, part):
    monkeypatch.setattr(nj, "PART_EDGES", part)
    rng = random.Random(part)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(200, i) for i in range(201, 230)]
    rng.shuffle(edges)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = [(r.node, r.comp) for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}


def test_other_thresholds(spark):
    compare(spark, corpus(8, 150), k=5, num=80, den=100)
    compare(spark, corpus(8, 150), k=2, num=100, den=100)


def test_chain_of_copies_is_one_component(spark):
    """Each text links only with its neighbours."""
    w = [f"w{i}" for i in range(400)]
    compare(spark, [(i, " ".join(w[3 * i:3 * i + 60])) for i in range(60)])


def test_small_table_by_brute_force(spark):
    docs = common.read_documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_components(docs).collect())
    assert got == brute(rows)


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, t), (5, t + " z"), (5, t + " z"), (None, "alone here"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.ngram_components(df).collect()))
    assert got == [(-1, 1, -1), (-1, 47, 5), (5, 48, 5), (5, 48, 5), (7, 0, 7)]
    assert nj.ngram_components(df.limit(0)).count() == 0


def test_word_hashes_follow_the_contract():
    """Equal words, equal hashes; only A-Z are folded; only six characters are spaces."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("aAbÉé \t\n\x0b\x0c\r\u00a0\u2003\x1c", k=rng.randint(0, 30))) for _ in range(400)]
    known = {}
    for t in texts:
        words = t.encode().lower().split()
        start, h = nj.word_hashes(t.encode().lower())
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    for k in (1, 3):
        assert [len(s) for s in nj.shingles(texts, k)] == [len(s) for s in sets_of(texts, k)]


def test_bitmap_has_no_false_negatives(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "rep")
    got = {r.id for r in spark.range(5000).filter(common.id_filter(ids, "rep")("id")).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 760


def test_finer_points_bound_the_overlap():
    rng = np.random.default_rng(4)
    big = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1500, 2500, 5000, 9000)]
    sets = big + [np.unique(np.append(s[rng.random(len(s)) > 0.1], rng.integers(0, 1 << 63, len(s) // 10).astype(np.uint64))) for s in big]
    p = nj.Points([nj.point(s) for s in sets])
    assert {len(f) for f in p.fine} >= {128, 256, 512, 1024} and [int(c.sum()) for c in p.coarse] == [len(s) for s in sets]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            coarse = int(np.minimum(p.coarse[i], p.coarse[j]).sum())
            assert len(np.intersect1d(s, t)) <= p.bound(i, j) <= coarse
    n = np.array([len(s) for s in sets])
    assert p.refine(np.arange(4), np.arange(4, 8), n, 70, 100).all()


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    for i in range(200):
        s = sets[rng.integers(0, 40)]
        sets.append(np.unique(np.append(s[rng.random(len(s)) > 0.08], rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64))))
    sets = [s for s in sets if len(s)]
    tree = nj.CountRTree(nj.Points([nj.point(s) for s in sets]).coarse, np.array([len(s) for s in sets]))
    found = {(int(a), int(b)) for i, j in tree.search(np.arange(len(sets)), 85, 100) for a, b in zip(i, j)}
    links = 0
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            if 100 * both >= 85 * (len(s) + len(t) - both):
                links += i != j
                assert (i, j) in found
    assert links > 100 and len(found) < len(sets) ** 2 / 2
