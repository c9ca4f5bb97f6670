"""Rule ensemble: held-out accuracy, compiled rules equal the fitted ones, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import common, quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = common.read_documents(spark, SF), common.read_table(spark, SF, "labels")
    return quality.quality_scores(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out & scored.quality.notna()]
    assert len(held) > 500
    right = held.predicted == held.quality
    low, high = held[held.quality == 0], held[held.quality == 1]
    assert right.mean() > 0.97, right.mean()
    assert (high.predicted == 1).mean() > 0.97 and (low.predicted == 0).mean() > 0.9
    order = held.sort_values("score")
    rank = np.arange(1, len(order) + 1)
    auc = (rank[order.quality == 1].sum() - len(high) * (len(high) + 1) / 2) / (len(high) * len(low))
    assert auc > 0.95
    assert scored.score.between(0, 1).all() and len(scored) == 10000


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    assert model["rules"]
    names = ["a", "b", "c"]
    got = spark.createDataFrame(x.tolist(), names).select(quality.compile_score(model, names).alias("s")).toPandas().s.to_numpy()
    z = np.full(len(x), model["intercept"])
    for w, tests in model["rules"]:
        on = np.ones(len(x), bool)
        for j, op, t in tests:
            on &= x[:, j] <= t if op == "<=" else x[:, j] > t
        z += w * on
    want = 1 / (1 + np.exp(-z))
    assert np.allclose(np.sort(got), np.sort(want))
    assert ((want > 0.5) == y).mean() > 0.95


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "word " * 50000, "z"), (3, " \n\t ", "w"), (4, "$%& ### ***", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (2, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == 6


def test_one_class_has_smoothed_share():
    m = quality.fit_rules(np.zeros((8, 2)), np.ones(8, int))
    assert m["rules"] == [] and abs(1 / (1 + np.exp(-m["intercept"])) - 0.9) < 1e-9


def test_no_shuffle_no_python_in_scoring(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x = quality.score(docs, {"intercept": 0.1, "rules": [(1.0, [(0, ">", 3.0)])]}, ["doc_id"])
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert x.select(F.sum("predicted")).first()[0] is not None
