"""Fill-in-the-middle against a version that cuts lists of units."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.llm import fill_middle as fm
from textlab.llm import queries as Q

TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abZ \n\t09.<>PSM-é漢\U0001F600\x00"), st.characters(codec="utf-8")), max_size=80)
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def by_lists(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8), st.data())
def test_cuts_equal_lists_of_units(texts, data):
    units = fm.Units(texts)
    lists = [UNIT.findall(t) for t in texts]
    assert units.n.tolist() == [len(x) for x in lists]
    k = [data.draw(st.integers(0, len(x))) for x in lists]
    assert units.cut(np.array(k)).tolist() == [len("".join(x[:i])) for x, i in zip(lists, k)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_ranks(symbols):
    m = fm.WaveletMatrix(np.array(symbols, np.uint8), 3)
    at = np.arange(len(symbols) + 1)
    for c in range(8):
        assert m.rank(c, at).tolist() == [symbols[:i].count(c) for i in at]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in Q.op11(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {by_lists(r.doc_id, r.text) for r in docs}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a <P> b"), (4, "word " * 60_000), (4, "word " * 60_000), (None, "x<y<S"), (6, "<S"), (7, "<<M")]
    rows += [(100 + i, t) for i, t in enumerate(["a", " ", "<", "M>a", "ab cd", "<S<P", "\x00b", "é"] * 6)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, n int, form string")
    x = fm.fill_in_middle(df)
    got = x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fm.restored(F.col("output"), F.col("form")), 256)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((by_lists(a, b) for a, b in rows), key=key)
    assert fm.fill_in_middle(df.limit(0)).count() == 0


def test_groups_do_not_change_results(monkeypatch):
    texts = ["ab c", "", "x" * 30, "1 2 3", "é é"] * 5
    zero = np.zeros(len(texts), np.int64)
    want = fm._transform(texts, zero + 3, zero + 7, zero.astype(bool), zero.astype(bool))
    monkeypatch.setattr(fm, "GROUP", 7)
    parts = [fm._transform(texts[s], zero[s] + 3, zero[s] + 7, zero[s].astype(bool), zero[s].astype(bool)) for s in fm._groups(texts)]
    assert len(parts) > 5 and [tuple(r) for p in parts for r in p.fillna(-1).to_numpy()] == [tuple(r) for r in want.fillna(-1).to_numpy()]
