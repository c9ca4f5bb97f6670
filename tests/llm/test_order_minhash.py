"""Order MinHash against a plain Python selection; neighbours; no Python in the plan."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from textlab.llm import common
from textlab.llm import order_minhash as om


def rows_of(spark, rows):
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, fp string")
    return om.fingerprints(df)


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        nxt, t = order[(i + 1) % len(order)][1] or "", t or ""
        n = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest())
    return out


def random_rows(n=120):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["on", "é", "ra", "😀", "st", "a"], k=rng.randint(1, 4)))
    rows = [(i * 7 % 1000, " ".join(word() for _ in range(rng.randint(0, 90)))) for i in range(n)]
    return [*rows, (2000, None), (2001, ""), (2002, "same line here\n" * 300), (2003, " \t lead and trail \n")]


def test_edits_and_neighbours(spark, monkeypatch):
    rows = random_rows()
    want = edited(rows)
    for size in (om.RANGE_BYTES, 3000):
        monkeypatch.setattr(om, "RANGE_BYTES", size)
        got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows_of(spark, rows).collect()}
        assert got == want


def test_fingerprint_by_definition(spark):
    """Occurrence-numbered k-mers, the least picks of each hash range, text order, one hash per tuple."""
    rows = random_rows(30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fp for r in om.with_fingerprint(df, "text", "fp").collect()}
    words = {d: (t or "").split() for d, t in rows}
    flat = [(d, i, w[i:i + om.K] if len(w) >= om.K else None, w) for d, w in words.items() for i in range(max(len(w) - om.K + 1, 1 if w else 0))]
    kmers = spark.createDataFrame([(d, i, k or w) for d, i, k, w in flat], "d long, i int, k array<string>")
    h = F.transform("k", lambda w: F.xxhash64(w))
    kmers = kmers.withColumn("w", h).select("d", "i", F.when(F.size("w") < om.K, F.xxhash64("w")).otherwise(F.xxhash64(*[F.get("w", F.lit(j)) for j in range(om.K)])).alias("h")).collect()
    items, seen = {}, {}
    for r in sorted(kmers, key=lambda r: (r.d, r.i)):
        n = seen[r.d, r.h] = seen.get((r.d, r.h), -1) + 1
        items.setdefault(r.d, []).append((r.i, r.h, n))
    hashed = spark.createDataFrame([(d, *x) for d, v in items.items() for x in v], "d long, i int, h long, n int").select("d", "i", F.xxhash64("h", "n").alias("key")).collect()
    by = {}
    for r in hashed:
        by.setdefault(r.d, []).append((r.key, r.i))
    width = (1 << 64) // om.SKETCHES
    picks = []
    for d, v in by.items():
        for b in range(om.SKETCHES):
            low = -(1 << 63) + b * width
            chosen = sorted(x for x in v if low <= x[0] < low + width)[:om.PICKS]
            if chosen:
                picks.append((d, b, [k for k, _ in sorted(chosen, key=lambda x: x[1])]))
    want = {d: [0] * om.SKETCHES for d in words}
    for r in spark.createDataFrame(picks, "d long, b int, k array<bigint>").select("d", "b", F.hash("k").bitwiseOR(F.lit(1)).alias("t")).collect():
        want[r.d][r.b] = r.t
    assert got == want


def test_likeness(spark):
    got = om.fingerprints(common.read_documents(spark, "/root/testdata/sf0.01")).toPandas()
    assert len(got) == 1000 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long_ = got[got.n_chars > 600]
    assert long_.near_edited.mean() > 0.2 > 0.1 > long_.near_next.median()
    assert (long_.near_edited > long_.near_next).mean() > 0.95
    assert (got.fingerprint.str.len() == 8 * om.SKETCHES).all()


def test_order_counts(spark):
    w = [f"w{i}" for i in range(300)]
    swapped = w[150:] + w[:150]
    mixed = [x for i in range(0, 300, 3) for x in w[297 - i:300 - i]]
    rows = [(1, " ".join(w)), (2, " ".join(swapped)), (3, " ".join(mixed)), (4, " ".join(w))]
    fp = {r.doc_id: np.array(r.fp) for r in om.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp").collect()}
    same = lambda a, b: float((fp[a] == fp[b]).mean())
    assert same(1, 4) == 1.0 and same(1, 2) < 0.85 and same(1, 3) < 0.3


def test_ties_nulls_and_single_rows(spark):
    assert [r.near_next for r in rows_of(spark, [(1, "only one text here")]).collect()] == [1.0]
    got = rows_of(spark, [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (None, "x"), (None, None)]).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    assert rows_of(spark, [(1, "x")]).limit(0).count() == 0
    assert om.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native_plan(spark):
    plan = om.fingerprints(common.read_documents(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(b") == 1
