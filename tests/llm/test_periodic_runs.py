"""Periodic runs against their definition."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import periodic_runs as pr
from textlab.llm import queries as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_definition(w):
    """Maximal stretches for every period, smallest period only."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(q % d == 0 and all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if planted and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = by_definition(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@st.composite
def repeating(draw):
    words = draw(st.lists(st.sampled_from("abc"), max_size=20))
    for _ in range(draw(st.integers(0, 3))):
        part = draw(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7))
        words += (part * 9)[:draw(st.integers(1, 9 * len(part)))] + draw(st.lists(st.sampled_from("abc"), max_size=3))
    return [x.encode() for x in words]


@settings(max_examples=500, deadline=None)
@given(repeating())
def test_runs_equal_the_definition(words):
    runs = pr.word_runs(words)
    assert runs == by_definition(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    assert pr.kept_words(words, runs) == [x for i, x in enumerate(words) if i not in gone]


@settings(max_examples=100, deadline=None)
@given(repeating())
def test_whole_sequences_without_the_split(words):
    ids = {}
    assert sorted(pr.stretch_runs([ids.setdefault(w, len(ids)) for w in words]), key=lambda r: (r[0], r[2])) == by_definition(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_automaton_knows_every_factor(symbols):
    a = pr.SuffixAutomaton(symbols)
    for i in range(len(symbols)):
        state = 0
        for s in symbols[i:]:
            state = a.next[state][s]
    assert [a.length[x] for x in a.ends] == list(range(1, len(symbols) + 1))


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 40), st.data())
def test_colours(n, data):
    """Accesses against a walk up the tree."""
    parent = [-1] + [data.draw(st.integers(0, i - 1)) for i in range(1, n)]
    paths, colour = pr.ColouredPaths(parent), [-1] * n
    for c in range(60):
        v = data.draw(st.integers(0, n - 1))
        met, at = [], v
        while at >= 0:
            if colour[at] >= 0 and (not met or met[-1][0] != colour[at]):
                met.append((colour[at], at))
            colour[at], at = c, parent[at]
        assert paths.access(v, c) == met


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in Q.op12(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {row(r.doc_id, r.text) for r in docs}
    assert got == want and any(r[1] for r in want)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5), (5, "a " * 6), (6, "a b " * 4), (7, "x " * 30 + "y z " * 30), (7, "x " * 30 + "y z " * 30),
            (None, "q q q q q q q"), (8, "a b c " * 200), (9, "a a a a a a a"), (10, "one two three " * 3)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, runs int, key string")
    x = pr.periodic_runs(df)
    got = [(r.doc_id, len(r.runs), *(r.best or (None, None, None)), r.best and 1000 * r.best.length // r.best.period) for r in x.collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted((row(a, b, planted=False)[:6] for a, b in rows), key=key)
    assert pr.periodic_runs(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "z y " + "a b c " * 50_000)], "doc_id long, text string")
    r = pr.periodic_runs(long).first()
    assert [tuple(x) for x in r.runs] == [(2, 150_000, 3)] and r.collapsed == "z y a b c"
