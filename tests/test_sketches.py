"""Mergeable distinct sketches against exact counts."""

from pyspark.sql import functions as F

from textlab.operators import stats as A


def test_merged_slices_are_near_the_exact_count(spark):
    n = 60_000
    t = spark.range(n).select((F.col("id") % 7).alias("slice"), F.lit("x").alias("lang"),
                              F.array((F.col("id") % 50_000).cast("string"), F.lit("the")).alias("types"), F.array((F.col("id") % 9).cast("string")).alias("lemma_types"))
    slices = A.type_sketches(t, ["slice", "lang"])
    r = A.merge_type_sketches(slices, ["lang"]).first()
    assert abs(r.types_raw - 50_001) <= 50_001 * A.SKETCH_ERROR and r.types_lemmas == 9
    # a slice that is there twice changes nothing
    assert A.merge_type_sketches(slices.unionAll(slices.where("slice = 3")), ["lang"]).first() == r


def test_empty_arrays_and_tables(spark):
    t = spark.createDataFrame([("a", [], ["l"]), ("a", ["x"], []), (None, [], [])], "lang string, types array<string>, lemma_types array<string>")
    got = {r.lang: (r.types_raw, r.types_lemmas) for r in A.merge_type_sketches(A.type_sketches(t, ["lang"]), ["lang"]).collect()}
    assert got == {"a": (1, 1), None: (0, 0)}
    assert A.type_sketches(t.limit(0), ["lang"]).count() == 0
