"""Scalar rules against their Python definitions on random strings."""

import re
import string

from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from textlab.functions import text as T

WS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
ALPHABET = st.sampled_from(list(WS) + list(string.printable) + ["ä", "é", "ß", "İ", "漢", " ", " "])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=60)
SPECIAL = set(string.punctuation + string.digits)


def py_clean(t: str) -> str:
    if len(t) == 1:
        return t
    return "<SPECIAL>" if all(ch in SPECIAL for ch in t) else t


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_strip_and_clean_token_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.c) for r in df.select("i", T.strip("t").alias("s"), T.clean_token("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.strip(), py_clean(t)), repr(t)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_tokens_keep_every_character(spark, texts):
    """Segmentation and tokenisation only insert separators: the tokens of a
    document, concatenated, are the document without whitespace.  One exception
    (Treebank quotes): a straight double quote becomes `` or ''."""
    assume(all("<ENUM" not in t for t in texts))   # raw "<ENUMn>" unmasks to "n." by design
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "i int, lang string, t string")
    toks = T.token_array(T.mark_sentences("t", "lang"))
    got = {r.i: r.j for r in df.select("i", F.array_join(toks, "").alias("j")).collect()}
    for i, t in enumerate(texts):
        want = "".join("(?:``|'')" if ch == '"' else re.escape(ch) for ch in t if not ch.isspace())
        assert re.fullmatch(want, got[i]), repr(t)


TOKS = st.lists(st.sampled_from(["a", "b", "c", "12", "..", ".", "x-y", "ä"]), max_size=9)


def py_novelty(a, b, n):
    a = [py_clean(t) for t in a]
    b = [py_clean(t) for t in b]
    ga = {tuple(a[i:i + n]) for i in range(len(a) - n + 1)}
    gb = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
    return 0 if not gb else len(gb - ga) / len(gb)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TOKS, TOKS), min_size=1, max_size=40))
def test_ngrams_and_novelty_match_python(spark, pairs):
    from textlab.functions import rules as R
    from textlab.operators import stats as A
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    out = A.with_novelty(df.select("i", "a", "b", *[T.ngrams("b", n).alias(f"g{n}") for n in (1, 2, 3, 4)]),
                         "a", "b", (1, 2, 3, 4))
    rows = {r.i: r for r in out.collect()}
    for i, (a, b) in enumerate(pairs):
        r = rows[i]
        for n in (1, 2, 3, 4):
            want = [R.GRAM_SEP.join(b[k:k + n]) for k in range(len(b) - n + 1)]
            assert r[f"g{n}"] == want
            assert abs(r[f"nov_{n}"] - py_novelty(a, b, n)) < 1e-12


WORDS = st.lists(st.sampled_from(["the", "cat", "sat", "on", "mat", "a", "dog"]), max_size=8)


def py_bleu(pairs):
    from collections import Counter
    import math
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for ref, sys in pairs:
        sys_len += len(sys)
        ref_len += len(ref)
        for n in range(1, 5):
            cs = Counter(tuple(sys[i:i + n]) for i in range(len(sys) - n + 1))
            cr = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
            correct[n - 1] += sum(min(c, cr[g]) for g, c in cs.items())
            total[n - 1] += sum(cs.values())
    prec, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            prec[n] = 100.0 / (smooth * total[n])
        else:
            prec[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0)
    return bp * math.exp(sum(math.log(p) if p > 0 else -9999999999 for p in prec) / 4)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=25))
def test_bleu_matches_definition(spark, pairs):
    from textlab.operators import evaluation as EV
    rows = [("", i, " ".join(r), " ".join(r), " ".join(y)) for i, (r, y) in enumerate(pairs)]
    ev = EV.Eval(spark.createDataFrame(rows, "split string, pair_id long, orig string, ref string, y0 string"), ("s",))
    got = EV.bleu(ev).first().bleu
    assert abs(got - py_bleu(pairs)) < 1e-9
