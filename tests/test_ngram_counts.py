"""The n-gram counts of the evaluation: one kernel call per pair, rows of one pair together."""

from __future__ import annotations

import io
from collections import Counter
from contextlib import redirect_stdout

from textlab.functions import text as T
from textlab.operators import evaluation as EV

ROWS = [
    ("a", 1, "The cat's 3.5, and the 10-year cat.", "the cat &amp; the dog", "The cat the cat", None),
    ("a", 1, "a second row of the pair", "a row", "a a a", "the"),
    ("a", 2, None, "", "  ", "x"),
    ("b", None, "ΑΣ. ΒΣ &QUOT; İ <SKIPPED>", "ΑΣ", "B-\nC D", "B C"),
]
SCHEMA = "split string, pair_id bigint, orig string, ref string, y0 string, y1 string"


def test_counts_equal_those_of_the_token_columns(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {}
    for r in EV.ngram_counts(EV.Eval(rows, ("p", "q"))).where("gram is not null").collect():
        key = (r.split, r.pair_id, r.kind, r.n, r.gram)
        assert key not in got
        got[key] = [r.c_orig, r.c_ref, r.c0, r.c1]
    want = {}
    make = {"rouge": T.rouge_tokens, "bleu": T.tokens_13a, "sari": lambda c: T.tokens_13a(c, lowercase=True)}
    for kind, tokens in make.items():
        for side, name in enumerate(("orig", "ref", "y0", "y1")):
            if side == 0 and kind != "sari":
                continue
            for n in EV._orders(kind):
                for r in rows.select("split", "pair_id", T.ngrams(tokens(name), n).alias("g")).collect():
                    for gram, k in Counter(r.g or []).items():
                        want.setdefault((r.split, r.pair_id, kind, n, gram), [0, 0, 0, 0])[side] += k
    assert got == want


def test_no_table_of_ngrams_is_grouped(spark):
    ev = EV.Eval(spark.createDataFrame(ROWS, SCHEMA), ("p", "q")).clustered()
    out = io.StringIO()
    with redirect_stdout(out):
        EV.ngram_counts(ev).explain()
    plan = out.getvalue()
    assert plan.count("ArrowEvalPython") == 1
    assert "gram" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)
