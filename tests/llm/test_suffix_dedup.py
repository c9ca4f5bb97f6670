"""Repeated byte strings against a table of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import common
from textlab.llm import suffix_dedup as sd


def brute(texts):
    n = sd.LENGTH
    count = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        spans = sd.covered([(i, i + n) for i in range(len(t) - n + 1) if count[t[i:i + n]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, df=None):
    df = df if df is not None else spark.createDataFrame([(i, t.decode(), 3) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_bytes(df).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["on", "th", "re", "a", "é", "st"], k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(k) for k in (70, 90, 120, 200, 400)]
    texts = []
    for i in range(60):
        t = [text(rng.randint(0, 150))]
        if i % 3:
            p = rng.choice(passage)
            a = rng.randint(0, 20)
            t += [p[a:len(p) - rng.randint(0, 20)], text(rng.randint(0, 60))]
        if i % 10 == 0:
            t = [texts[-1].decode() if texts else "x"]
        if i % 7 == 0:
            c = list(" ".join(t))
            for _ in range(rng.randint(0, 5)):
                c[rng.randrange(len(c))] = "q"
            t = ["".join(c)]
        texts.append(" ".join(t).encode())
    return [*texts, b"", b"ab" * 600, b"x" * 399, b"x" * 400, b"y" * 401, text(90).encode() * 3]


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    compare(spark, planted(seed))


def test_whole_small_table(spark):
    docs = common.read_documents(spark, "/root/testdata/sf0.001").orderBy("doc_id")
    compare(spark, [r.text.encode() for r in docs.collect()], docs)


def test_runs_of_any_size_merge_alike(spark, monkeypatch):
    texts = planted(9)
    monkeypatch.setattr(sd, "PART_BYTES", 4000)
    compare(spark, texts)


def test_null_rows_and_repeated_rows(spark):
    t = "some words " * 60
    df = spark.createDataFrame([(1, t), (1, t), (None, None), (None, t + "x"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.repeated_bytes(df).collect())
    assert got == [(0, 0, 0), (0, 661, 660), (1, 660, 660), (1, 660, 660), (2, 0, 0)]
    assert sd.repeated_bytes(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=30), max_size=7))
def test_loser_tree_sorts_and_knows_prefixes(runs):
    runs = [sorted(r) for r in runs]
    coded = [sd.decode(list(sd.front_code([(s, b"", [(i, 0)]) for s in r]))) for i, r in enumerate(runs)]
    out = list(sd.LoserTree(coded))
    assert [s for _, s, _, _ in out] == sorted(sum(runs, []))
    last = b""
    for known, s, _, _ in out:
        assert known == sd.lcp(last, s)
        last = s


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=90).map(lambda b: bytes(x % 2 for x in b)), st.binary(max_size=90).map(lambda b: bytes(x % 2 for x in b)))
def test_lcp(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert sd.lcp(a, b) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=4, max_size=9), st.binary(max_size=6), st.booleans()).map(lambda x: (bytes(97 + c % 2 for c in x[0]), bytes(97 + c % 2 for c in x[1]), x[2])), min_size=1, max_size=12))
def test_extremes_by_definition(group):
    n, w = sd.LENGTH, sd.WINDOW
    sd.LENGTH, sd.WINDOW = 8, 5
    try:
        group = sorted({(s[:8], left[:4]): (s[:8], left[:4], m) for s, left, m in group}.values())
        known = [0] + [sd.lcp(a[0], b[0]) for a, b in zip(group, group[1:])]
        low, high = sd.extremes([g[0] for g in group], known, [g[1] for g in group], [g[2] for g in group])
        for i, (s, left, many) in enumerate(group):
            ts = [t for t in range(5) if len(left) >= t and len(s) >= 8 - t and (many or any(
                j != i and len(b) >= t and len(a) >= 8 - t and (b[:t], a[:8 - t]) == (left[:t], s[:8 - t]) for j, (a, b, _) in enumerate(group)))]
            assert (low[i], high[i]) == ((ts[0], ts[-1]) if ts else (8, -1))
    finally:
        sd.LENGTH, sd.WINDOW = n, w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"a" * 250, b"a" * 250 + b"b", b"a" * 300, b"b" * 220]), st.sampled_from([b"", b"x", b"xy"])), max_size=12))
def test_groups(items):
    items = sorted((s, left, [(i, i)]) for i, (s, left) in enumerate(items))
    merged, last = [], b""
    for s, left, o in items:
        merged.append((sd.lcp(last, s), s, left, o))
        last = s
    got = list(sd._groups(iter(merged)))
    seen = {}
    for suffixes, known, lefts, occ in got:
        assert all(k == sd.lcp(a, b) for k, a, b in zip(known[1:], suffixes, suffixes[1:]))
        assert len(set(zip(suffixes, lefts))) == len(suffixes)
        for s, left, o in zip(suffixes, lefts, occ):
            seen[s, left] = sorted(o)
    want = {}
    for s, left, o in items:
        want.setdefault((s, left), []).extend(o)
    for key, o in seen.items():
        assert want[key] == o
    for (s, left), o in want.items():  # left out only if alone
        if (s, left) not in seen:
            assert len(o) == 1 and not any(k != (s, left) and sd.lcp(k[0], s) >= sd.SHARED for k in want)
