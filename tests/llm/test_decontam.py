"""Leaks of benchmark items: recall of planted passages, exact distances, no false ones."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import common, decontam


def brute(item, window):
    """Smallest edit distance to any substring, by the table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in window:
        new = [0]
        for i, d in enumerate(item):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=90).map(lambda b: bytes(x % 3 for x in b)))
def test_distance(item, window):
    assert decontam.distance(item, window) == brute(item, window)


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = "q"
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, "z")
    return "".join(t)


def test_recall_and_precision_on_planted_passages(spark):
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in common.read_table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    syll = ["on", "the", "ra", "mi", "re", "sto", "ing", "ti"]
    words = lambda n: " ".join("".join(rng.choices(syll, k=rng.randint(1, 4))) for _ in range(n))
    docs, planted = [], {}
    for d in range(400):
        body = [words(60), words(60)]
        if d % 2:
            i, t = rng.choice(items)
            e = (d // 2 % 4) * 2
            planted[d] = (i, e)
            body.insert(1, edited(rng, t, e).upper() if d % 5 == 0 else edited(rng, t, e))
        docs.append((d, "\n  ".join(body)))
    docs += [(400, None), (401, ""), (402, items[0][1]), (402, items[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([*items, (900, None), (901, ""), (902, "the on ra")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(df, it).collect()]
    assert {d for d, _, _ in got} - set(planted) == {402} and sum(d == 402 for d, _, _ in got) == 2
    found = {(d, i) for d, i, _ in got}
    by = {}
    for d, (i, e) in planted.items():
        by.setdefault(e, []).append((d, i) in found)
    assert all(by[0]) and np.mean(by[2]) >= 0.95 and np.mean(by[4]) >= 0.9 and np.mean(by[6]) >= 0.85, {k: np.mean(v) for k, v in by.items()}
    texts, by_id = dict(docs), dict(items)
    for d, i, k in got[:20]:
        item = decontam.normalise(by_id[i])
        assert k == brute(item, decontam.normalise(texts[d])) or k <= 0.1 * len(item)


def test_equals_brute_force_on_the_table(spark):
    """All rows of a small table against all items, by the edit table of words of exact passages."""
    sf = "/root/testdata/sf0.001"
    docs, items = common.read_documents(spark, sf), common.read_table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    its = [(r.item_id, decontam.normalise(r.text)) for r in items.collect()]
    want = set()
    for r in docs.collect():
        t = decontam.normalise(r.text)
        want |= {(r.doc_id, i) for i, x in its if x in t}
    assert want <= got and len(got - want) <= 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here that are long enough")], "item_id long, text string")
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), items).count() == 0


def test_slices_find_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = common.read_documents(spark, sf), common.read_table(spark, sf, "benchmark")
    one = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, items).collect())
    monkeypatch.setattr(decontam, "SLICE_BYTES", 3000)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, items).collect()) == one


def test_recall_at_the_limit(spark):
    """Copies with as many edits as the limit allows, against brute force, for long and short items."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in common.read_table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    texts = [r.text for r in common.read_documents(spark, "/root/testdata/sf0.001").collect() if r.text]
    items += [(1000 + k, rng.choice(texts)[:n]) for k, n in enumerate([24, 25, 29, 30, 39, 40, 49, 60] * 25)]
    share = {}
    for kind, index in (("long", decontam.ItemIndex(items[:200], decontam.RATIO)), ("short", decontam.ItemIndex(items[200:], decontam.RATIO))):
        for part in (0.06, 0.08, 0.1):
            docs = []
            for i, t in index.items:
                t = t.decode(errors="replace")
                docs.append(f"{rng.choice(texts)[:80]} {edited(rng, t, int(part * len(t.encode())))} {rng.choice(texts)[:40]}")
            found = {(d, i) for d, i, _ in index.search(docs)}
            want = [d for d, (_, t) in enumerate(index.items) if brute(t, decontam.normalise(docs[d])) <= 0.1 * len(t)]
            assert len(want) > 100
            share[part, kind] = np.mean([(d, d) in found for d in want])
    assert min(share.values()) >= 0.9, share


def test_short_items_are_found_exactly(spark):
    """Exact copies of items from LEAST_ITEM to 60 bytes, whatever the place and whatever else is in the slice."""
    rng = random.Random(12)
    texts = [decontam.normalise(r.text).decode() for r in common.read_documents(spark, "/root/testdata/sf0.001").collect() if r.text]
    items, docs = [], []
    for size in range(24, 61):
        for _ in range(5):
            t = rng.choice([x for x in texts if len(x) > 200])
            at = rng.randrange(len(t) - 100)
            while len(cut := decontam.normalise(t[at:at + size])) != size:
                t, at = rng.choice([x for x in texts if len(x) > 200]), rng.randrange(100)
            items.append((len(items), cut.decode()))
            docs.append(t[:at + size + rng.randrange(40)])
    want = {(d, d) for d in range(len(items))}
    for slice_ in (items, [*items, (999, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3)]):
        found = {(d, i) for d, i, k in decontam.ItemIndex(slice_, decontam.RATIO).search(docs) if k == 0}
        assert want <= found, len(want - found)
    for i, t in items[:40]:
        alone = decontam.ItemIndex([(i, t)], decontam.RATIO)
        assert (0, 0, 0) in set(alone.search([docs[i]]))


def test_copies_inside_space_free_runs():
    """Texts without spaces: exact copies and copies at half the limit inside a longer run."""
    rng = random.Random(13)
    signs = [chr(0x4E00 + 7 * i) for i in range(400)] + [chr(0x3042 + i) for i in range(40)]
    run = lambda n: "".join(rng.choices(signs, k=n))
    url = lambda n: "".join(rng.choices("abcdefghij0123456789/-_", k=n))
    for make in (run, url):
        items = [(i, make(rng.randint(24, 90))) for i in range(60)]
        index = decontam.ItemIndex(items, decontam.RATIO)
        exact = {(d, i) for d, i, k in index.search([make(rng.randint(1, 80)) + t + make(50) for _, t in items]) if k == 0}
        assert exact == {(i, i) for i, _ in items}
        near = {(d, i) for d, i, k in index.search([make(rng.randint(1, 80)) + edited(rng, t, len(t) // 30) + make(50) for _, t in items])}
        assert len(near) >= 0.9 * len(items)
