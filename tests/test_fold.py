"""Lemmas folded back into token arrays: wide columns travel once a row, positions are kept."""

from pyspark.sql import functions as F

from textlab.operators import segment as S

SCHEMA = "k long, lang string, wide array<string>, a array<string>, b array<string>"
ENTRIES = [("en", "is", "be"), ("en", "was", "be"), ("en", "same", "same"), ("en", ".", "--"), ("de", "ist", "sein")]


def _fold(spark, rows):
    d = spark.createDataFrame(ENTRIES, "lang string, token string, lemma string")
    df = spark.createDataFrame(rows, SCHEMA)
    return S.fold_lemmas(df, d, ["k"], ["a", "b"], lambda t, m: F.concat_ws(":", t, m))


def test_positions_of_several_arrays(spark):
    rows = [(1, "en", ["w"], ["is", "x", "was", "."], ["same", "is"]), (2, "de", None, ["is", "ist"], []), (3, "en", ["v"], [], ["was"]),
            (4, "en", [], [], []), (5, None, ["u"], ["is"], ["ist"]), (6, "en", ["t"], None, ["is"]), (None, "en", ["s"], ["is"] * 300, ["x"])]
    lemma = {(x, t): m for x, t, m in ENTRIES if m != "--"}
    got = {r.k: r for r in _fold(spark, rows).collect()}
    assert len(got) == len(rows)
    for k, lang, wide, a, b in rows:
        want = [[f"{t}:{lemma.get((lang, t), t)}" for t in x] for x in ((a, b) if a is not None else ([], []))]
        assert [got[k].a, got[k].b] == want and got[k].wide == wide and got[k].lang == lang


def test_wide_columns_are_not_repeated_for_each_token(spark):
    df = _fold(spark, [(1, "en", ["w"], ["is"], ["x"])])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "first(wide" not in plan and plan.count("first(") == 1


def test_extended_dictionary_is_broadcast(spark, tmp_path):
    """A written dictionary above the optimizer's threshold: tokens are not shuffled by word."""
    many = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id")).alias("token"), F.lit("x").alias("lemma"))
    same = spark.range(50).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id")).alias("token"), F.concat(F.lit("s"), F.col("id")).alias("lemma"))
    many.unionByName(same).write.parquet(str(tmp_path / "d"))
    toks = spark.range(200).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id") * 30).alias("token"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        out = S.lemma_join(toks, spark.read.parquet(str(tmp_path / "d")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.lemma == "x" for r in out.where("cast(substr(token, 2) as int) < 3000").collect()} == {True}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sketches_and_exact_counts_tokenise_once(spark, monkeypatch):
    from textlab.plans import queries as Q
    seen = []
    real = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name="table": seen.append(name) or real(df, name))
    out = Q.queries()["type_counts_approx"](spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.raw_within_bound and r.lemmas_within_bound for r in out.collect())
