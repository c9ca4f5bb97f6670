"""Learned abbreviations against a plain version of the published score."""

import math
import re
from collections import Counter

from textlab.operators import abbreviations as AB
from textlab.sources import files as IO

DE = ["Das kostet ca. 5 Euro, bzw. ca. 6 Dollar. Er kam z.B. heute. Sie ging.", "Ca. 7 Leute kamen bzw. gingen usw. und so weiter. Alle waren da.",
      "Heute z.B. kam niemand. Es waren ca. 3 Tage. Das Haus steht da. Er ging bzw. lief."] * 8
EN = ["Dr. Smith met Mr. Jones. They talked. Mr. Jones left.", "The dog ran. The dog sat."] * 8


def by_definition(texts):
    with_stop, plain = Counter(), Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+(?:\.[^\W\d_]+)*\.?", t):
            (with_stop if w.endswith(".") else plain)[w.rstrip(".").lower()] += 1
    stops, words = sum(with_stop.values()), sum(with_stop.values()) + sum(plain.values())
    out = {}
    for w, k in with_stop.items():
        r, p, letters = plain[w], stops / words, len(w.replace(".", ""))
        ratio = 2 * (k * math.log(0.99 / p) + r * math.log(0.01 / (1 - p)))
        score = ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** -r
        if score >= 0.3:
            out[w] = (k, r, score)
    return out


def docs(spark):
    rows = [(i, "de", t) for i, t in enumerate(DE)] + [(100 + i, "en", t) for i, t in enumerate(EN)] + [(200, "xx", None), (201, "xx", ""), (202, None, "Only. Stops. Here.")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_scores(spark):
    got = {(r.lang, r.type): (r.n_stop, r.n_plain, r.score, r.forms) for r in AB.learn(docs(spark)).collect()}
    want = {(lang, w): v for lang, texts in (("de", DE), ("en", EN)) for w, v in by_definition(texts).items()}
    assert set(got) == set(want)
    for key, (k, r, score) in want.items():
        assert got[key][:2] == (k, r) and abs(got[key][2] - score) < 1e-9
    assert {"ca", "z.b", "bzw"} <= {t for lang, t in got if lang == "de"} and {"dr", "mr"} <= {t for lang, t in got if lang == "en"}
    assert got["de", "ca"][3] == ["Ca", "ca"]


def test_sentences_with_the_learned_list(spark):
    d = docs(spark)
    learned = AB.learn(d)
    got = {}
    for r in AB.sentences(d, learned).orderBy("doc_id", "sent_idx").collect():
        got.setdefault(r.doc_id, []).append(r.sent)
    assert got[0] == ["Das kostet ca. 5 Euro, bzw. ca. 6 Dollar.", "Er kam z.B. heute.", "Sie ging."]
    assert got[100] == ["Dr. Smith met Mr. Jones.", "They talked.", "Mr. Jones left."]
    assert got[202] == ["Only.", "Stops.", "Here."] and 200 not in got and 201 not in got


def test_empty_tables(spark):
    d = docs(spark).limit(0)
    assert AB.learn(d).count() == 0
    assert AB.sentences(docs(spark).where("doc_id = 101"), AB.learn(d)).count() == 2


def test_a_rerun_of_the_metric_sink_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "metrics")
    m = spark.createDataFrame([("a", "BLEU", 1.5), ("b", "BLEU", 2.5)], "system string, metric string, value double")
    for prefix, run in (("val", "1"), ("test", "1"), ("val", "2"), ("val", "1")):
        IO.save_metrics(m, path, prefix, samples=7, run=run)
    got = sorted((r.run, r.prefix, r.system, r.metric, r.value) for r in IO.read_metrics(spark, path).collect())
    assert got == sorted((run, p, s, *v) for run, p in (("1", "val"), ("1", "test"), ("2", "val"))
                         for s, b in (("a", 1.5), ("b", 2.5)) for v in (("BLEU", b), (f"{p}_samples", 7.0)))
