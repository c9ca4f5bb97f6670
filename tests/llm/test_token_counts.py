"""Transducer token counts against the library on whole texts."""

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import token_counts as tc

FILE = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=FILE)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("  \n\t\rabé▁<s>\x00"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_counts_equal_the_library(text, chunk):
    t = tc.transducer(FILE)
    assert t.tokens(text) == len(SP.encode(text))
    assert t.tokens(text, chunk) == len(SP.encode(text))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_scan_prefixes(text, chunk):
    t = tc.transducer(FILE)
    text = text.replace(tc.MARK, " ")
    maps = [t.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
    for k, m in enumerate(t.scan(maps)):
        assert t.count(" " + m.head) + m.count + t.count(m.tail) == len(SP.encode(text[:(k + 1) * chunk]))


def test_rows(spark):
    texts = [(1, None), (2, ""), (3, " a  b \n\n c "), (4, "word " * 5000), (4, "word " * 5000), (None, "x")]
    df = spark.createDataFrame([(a, b, "z") for a, b in texts], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, FILE).collect())
    want = sorted((a or 0, len((b or "").encode()), n := len(SP.encode(b or "")), n > 4096) for a, b in texts)
    assert got == want
    assert tc.token_counts(df.limit(0), FILE).count() == 0
