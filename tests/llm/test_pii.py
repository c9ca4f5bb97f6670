"""Personal data: base spans against the plain patterns, the field against enumeration."""

import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(text):
    """The patterns as given, searched from left to right over the whole text."""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


PARTS = st.sampled_from(["a.b@c.de", "x@y", "@@", "me_%+-@A-1.b-2.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4041894974608795", "4041 8949-7460 8795", "4041894974608796",
                         "+49 (0) 123-456", "+1234567", "+", " ", "-", ".", "12", "é", "\n", "word", "00000000000000000000", "+12 3 4.5.6.7 8 9 0"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_beliefs_equal_enumeration_on_a_tree():
    """Without loops, sum-product is exact."""
    rng = np.random.default_rng(1)
    g = pii.Graph(["aa 11111 bb cc 22222"])
    assert len(g.doc) == 5 and not len(g.skip)
    model = {"unary": rng.normal(size=(pii.FEATURES, 5)), "chain": rng.normal(size=(5, 5)), "skip": np.zeros((5, 5))}
    got, unary = g.beliefs(model), g.x @ model["unary"]
    want = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        p = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(model["chain"][y[i], y[i + 1]] for i in range(4)))
        for i in range(5):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_repeats_share_labels_over_a_distance():
    far = " word" * 60
    texts = [f"call +49 170 {k}{k}12345 today{far} 4041894974608795{far} mail joe{k}@mail{k}.org or from 10.0.{k}.7{far}"
             f" in {1950 + k} about {k} of {100 + k} left{far} or {3000 + 37 * k} more" for k in range(30)]
    model = pii.fit(texts)
    one = "pay 4041894974608795 now" + far + " write joe7@mail7.org" + far + " again joe7@mail7 please" + far + " in 1999 about 35 of 120 left"
    base, added = pii.find([one], model)
    assert [k for k, _, _ in base[0]] == [0, 2]
    assert [one[a:b] for _, a, b in added[0]] == ["joe7@mail7"]
    assert pii.find(["plain words in 1999, 3.5 km"], model)[1] == [[]]


def test_rows(spark):
    texts = [(1, "x a.b@c.de 4041894974608795"), (1, "x a.b@c.de 4041894974608795"), (2, None), (3, ""), (None, "é 1.2.3.4 +49 123 45678"), (4, "no data " * 30000)]
    df = spark.createDataFrame([(a, b, "s") for a, b in texts], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(df).collect())
    want = []
    for a, b in texts:
        s = plain(b or "")
        want.append((a or 0, *(sum(k == i for k, _, _ in s) for i in range(4)), hashlib.sha256(pii.spans_text(s).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_redact_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x a.b@c.de y", "en"), (2, None, "de"), (3, "clean", "fr")], "doc_id long, text string, lang string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x <email> y", 2: None, 3: "clean"}


def test_mask_overlaps():
    assert pii.mask("0123456789", [(0, 2, 5), (1, 4, 7), (2, 7, 8)]) == "01<email><card>89"
