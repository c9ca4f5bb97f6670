"""Patterns written for speed match what the plain ones match."""

import re

from pyspark.sql import functions as F

from textlab.functions import rules as R
from textlab.functions import text as T

ODD = ["", " ", "\"a\" 'b' cannot d'ye", "\"\"(\"x\" 'tis 'Twas", "x'\n\n's n't won't. dogs'\n\n's CANNOT gimme", "don't\u3000\"go\" , 3,4 a,b", "str 123 4a b5 ÿ œuf Œ hmm pst 12kg é'é", "İ ǅ ñ ß 1.2.3 ...a", "He'll they've I'm 'S ' x' \"."]


def test_whitespace_ranges_are_the_same_set():
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), R.WS_RANGES)
    ranges = re.compile("[" + body + "]")
    assert {c for c in range(0x10000) if ranges.fullmatch(chr(c))} == set(R.WHITESPACE_CODEPOINTS)
    assert R.WS_CLASS_BODY not in R.java_pattern(R.COLLAPSE_RULE[0])


def test_skipped_rules_change_nothing(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, t string").repartition(2)
    plain = F.concat(F.lit(" "), T.apply_rules("t", R.TOKEN_RULES), F.lit(" "))
    plain = T.apply_rules(T.apply_rules(plain, R.JOINED_WORD_RULES), R.CONTRACTION_RULES)
    for r in df.select("t", T.token_string("t").alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r.t


def test_flesch_counts(spark):
    """Words and syllables against a plain count per token; en constants, one sentence."""
    df = spark.createDataFrame([(x.split(),) for x in ODD], "toks array<string>")
    for r in df.select("toks", T.flesch("toks", F.lit(1), F.lit("en")).alias("fre")).collect():
        words = [t for t in r.toks if any(c.isalpha() for c in t)]
        runs = [len(re.findall("[" + R.VOWELS + "]+", t.lower())) for t in words]
        if not words:
            assert r.fre is None
            continue
        y = sum(max(1, n) for n in runs)
        b, a, c = R.FLESCH_CONSTANTS["en"]
        assert abs(r.fre - (b - a * len(words) - c * y / len(words))) < 1e-9, r.toks
