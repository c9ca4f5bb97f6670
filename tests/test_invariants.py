"""Properties without an oracle."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from textlab.functions import text as T
from textlab.operators import lcs as L
from textlab.operators import sections as SEC
from textlab.operators import segment as S
from textlab.sources import tables as src

SF = "/root/testdata/sf0.001"


def test_tokens_per_sentence_equal_tokens_per_document(spark):
    d = src.documents(spark, SF)
    per_doc = S.with_arrays(d).select("doc_id", "toks")
    per_sent = S.tokens(d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("sent_idx", "tok_idx", "token"))).alias("s"))
    per_sent = per_sent.select("doc_id", F.col("s.token").alias("t2"))
    j = per_doc.join(per_sent, "doc_id", "left")
    bad = j.where(F.coalesce(F.col("t2"), F.array().cast("array<string>")) != F.col("toks")).count()
    assert bad == 0


def test_enum_roundtrip(spark):
    d = src.documents(spark, SF)
    assert d.where(T.enum_unmask(T.enum_mask("text")) != F.col("text")).count() == 0


def test_sections_cover_document(spark):
    d = src.documents(spark, SF)
    secs = SEC.sections(d)
    re = secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "index", F.when(F.col("title_start").isNull(), F.lit("")).otherwise(F.col("title")).alias("t"), "text"))).alias("s"))
    re = re.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat(x["t"], x["text"])), "").alias("joined"))
    j = re.join(d, "doc_id")
    assert j.count() > 0
    assert j.where(F.col("joined") != F.col("text")).count() == 0


def test_identity_and_gold_metrics(spark):
    m = {(r.system, r.metric): r.value for r in E.queries()["evaluate_runs"](spark, SF).collect()}
    assert m[("identity", "Nov. (n=1)")] == 0 and m[("identity", "Nov. (n=2)")] == 0
    assert abs(m[("identity", "CMP_w")] - 1) < 1e-9
    assert m[("gold", "BLEU")] == 100.0
    sari = {r.system: r for r in E.queries()["sari"](spark, SF).collect()}
    assert sari["identity"].sari_add == 0 and sari["identity"].sari_del == 0
    assert sari["gold"].sari == 100.0


def _brute_union(ref, cans):
    """Tokens of ref on the LCS path with any candidate, by the full table."""
    pos = set()
    for c in cans:
        t = [[0] * (len(c) + 1) for _ in range(len(ref) + 1)]
        for i in range(1, len(ref) + 1):
            for j in range(1, len(c) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == c[j - 1] else max(t[i - 1][j], t[i][j - 1])
        i, j = len(ref), len(c)
        while i > 0 and j > 0:
            if ref[i - 1] == c[j - 1]:
                pos.add(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
    return [ref[p] for p in sorted(pos)]


def test_lcs_kernel_brute_force(monkeypatch):
    rnd = random.Random(7)
    for trial in range(600):
        alphabet = "abcdefgh"[: rnd.choice([2, 3, 5, 8])]
        word = lambda n: [rnd.choice(alphabet) for _ in range(rnd.randint(0, n))]
        ref, cans = word(14), [word(9) for _ in range(rnd.randint(0, 5))]
        monkeypatch.setattr(L, "MAX_CELLS", 5 if trial % 5 == 0 else 4_000_000)
        assert L.union_tokens(ref, cans) == _brute_union(ref, cans)


def test_lcs_memory_is_bounded(monkeypatch):
    """One long reference sentence against many one-token lines, and one long pair."""
    seen = []
    real = L._chunk_hits

    def spy(ref, can, starts, lens):
        seen.append((2 * int(len(ref) ** 0.5) + 2) * len(can))
        return real(ref, can, starts, lens)

    monkeypatch.setattr(L, "_chunk_hits", spy)
    ref = [f"t{i % 50}" for i in range(1000)]
    L.union_tokens(ref, [[f"t{i % 50}"] for i in range(200_000)])
    L.union_tokens(ref, [[f"t{i % 50}" for i in range(20_000)]])
    assert len(seen) > 2 and max(seen) <= L.MAX_CELLS


def test_rouge_lsum_gold_is_100(spark):
    r = {x.system: x for x in E.queries()["rouge_lsum"](spark, SF).collect()}
    assert r["gold"].fmeasure == 100.0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_marker_characters_are_ordinary_text(spark):
    rows = [(1, "Click \ue000 here now. Next \ue001 one \ue002\ue004 end."), (2, "\ue002"), (3, "a \ue000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("de"))
    got = {r.doc_id: r for r in S.with_arrays(df).collect()}
    assert got[1].sents == ["Click \ue000 here now.", "Next \ue001 one \ue002\ue004 end."]
    assert got[1].toks == ["Click", "\ue000", "here", "now", ".", "Next", "\ue001", "one", "\ue002\ue004", "end", "."]
    assert got[2].toks == ["\ue002"] and got[3].sents == ["a \ue000"]
    assert [r.token for r in S.tokens(df).where("doc_id = 3").orderBy("tok_idx").collect()] == ["a", "\ue000"]


def test_quotes_and_joined_words(spark):
    cases = {"„ja“ sagte er.": ["„", "ja", "“", "sagte", "er", "."], "«nein».": ["«", "nein", "»", "."],
             'I cannot, "gonna" CANNOT cannot stop.': ["I", "can", "not", ",", "``", "gon", "na", "''", "CAN", "NOT", "can", "not", "stop", "."],
             "'Tis wanna lemme go": ["'T", "is", "wan", "na", "lem", "me", "go"], "a canna cannots": ["a", "canna", "cannots"]}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    for r in df.select("text", T.sentence_tokens("text").alias("t")).collect():
        assert r.t == cases[r.text], r.text


def test_rounding_is_python_rounding(spark):
    rnd = random.Random(3)
    xs = [2.675, 0.125, 1.005, 2.5, -2.675, -0.5, 0.0, 1e-9, 123456.785] + [rnd.uniform(-999, 999) for _ in range(200)] + [rnd.randrange(10**5) / 1000 for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 2, 4):
        assert all(r.y == round(r.x, d) for r in df.select("x", T.round_exact("x", d).alias("y")).collect())
