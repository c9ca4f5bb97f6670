"""The transducer against the library, exact round trips, incremental decoding."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from textlab.llm import bpe_machine as bm
from textlab.llm import byte_bpe as bb
from textlab.llm import queries as Q

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bb.codec(FILE, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bb.read_ranks(FILE), special_tokens={})
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("  \n\taeiou'stre01é漢ا\x00\x1c\x85 "), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert "".join(CODEC.decode(ids)) == text


def test_every_character():
    """Letters and digits are those of the pattern's own engine, whatever its Unicode version."""
    for first in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} {c}1" for c in chars)
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text), hex(first)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text("ab", max_size=30), st.text("abc", max_size=30))
def test_any_vocabulary_of_merges(merges, known, text):
    """Every token joins two earlier ones (not each of them is reached by merging); symbols outside of them."""
    tokens = ["a", "b"]
    for i, j in merges:
        t = tokens[i % len(tokens)] + tokens[j % len(tokens)]
        if t not in tokens and len(t) < 12:
            tokens.append(t)
    ranks = {t: i for i, t in enumerate(tokens)}
    m = bm.TokenMachine(ranks)
    try:
        for t in tokens:
            m.halves(t)
    except ValueError:  # joined in an order in which merging does not join it
        assume(False)
    ids: list = []
    m.encode(known, ids)
    assert ids == [ranks[t] for t in m.merged(known)]
    assert bm.CountMachine(ranks, lambda c: 3).count(text) == sum(1 if t in ranks else 3 for t in m.merged(text))


def test_no_vocabulary_of_merges():
    with pytest.raises(ValueError, match="comes before a part"):
        bm.TokenMachine({"a": 0, "b": 1, "bba": 2, "bb": 3}).halves("bba")


def test_full_tables_change_nothing(monkeypatch):
    text = " ".join(f"word{i} näive{i * 7}" for i in range(300))
    want = CODEC.encode(text)
    monkeypatch.setattr(bm, "STATES", 50)
    monkeypatch.setattr(bm, "PAIRS", 20)
    monkeypatch.setattr(bb, "PATHS", 10)
    assert bb.ByteBpe(FILE, PATTERN).encode(text) == want


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.binary(max_size=20), TEXTS.map(str.encode), st.lists(st.sampled_from([0x41, 0x80, 0xC3, 0xE2, 0xED, 0xF0, 0xF4, 0x9F, 0xA0, 0xFF]), max_size=12).map(bytes)), st.data())
def test_decoder(data, draw):
    d, out, i = bb.Utf8Decoder(), [], 0
    while i < len(data):
        k = draw.draw(st.integers(1, 4))
        out.append(d.feed(data[i:i + k]))
        assert len(d.held) <= 3
        i += k
    assert "".join(out) + d.close() == data.decode("utf-8", "replace")


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in Q.op13(spark, sf).collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " a  b \n\n c "), (4, "wordé " * 50_000), (4, "wordé " * 50_000), (None, "x͸\U0003FFFF"), (5, "z" * 3000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, ids int")
    got = bb.decode_documents(bb.encode_documents(df, FILE, PATTERN), FILE, PATTERN).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=key) == sorted(((a, LIBRARY.encode_ordinary(b or ""), b or "") for a, b in rows), key=key)
    assert bb.encode_documents(df.limit(0), FILE, PATTERN).count() == 0
