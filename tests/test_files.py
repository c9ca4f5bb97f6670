"""Line numbering across many input splits and several part files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textlab.sources import files as IO
from textlab.sources import tables as src

SF = "/root/testdata/sf0.01"


def test_line_numbers_dense_and_ordered_across_splits(spark):
    docs = src.read_table(spark, SF, "documents")
    path = os.path.join(tempfile.mkdtemp(prefix="textlab-lines-"), "docs")
    IO.write_lines(docs.repartition(5), path, "text", "doc_id")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        lines = IO.read_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = [r.line for r in lines.orderBy("line_no").collect()]
        n = lines.agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count("*").alias("n")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [r.line for r in docs.orderBy("doc_id").select(
        IO.T.strip(F.regexp_replace("text", "\r\n|\r|\n", " ")).alias("line")).collect()]
    assert n.lo == 0 and n.hi == n.n - 1 == len(want) - 1
    assert got == want


def _write(folder, name, lines):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.fixture
def files(tmp_path):
    base = str(tmp_path)
    return {
        "orig": _write(base, "orig.txt", ["The cat sat on the mat .", "A dog ran over the road .", "  "]),
        "ref": _write(base, "ref.txt", ["The cat on the mat .", "A dog over the road .", "x"]),
        "a1": _write(base, "a/p1.txt", ["The cat on the mat .", "A dog over the road .", "x"]),
        "a2": _write(base, "a/p2.txt", ["The cat sat on the mat .", "A dog ran over the road .", "y"]),
        "short": _write(base, "short/p.txt", ["The cat ."]),
    }


def test_two_files_of_one_folder_are_two_runs(spark, files):
    with pytest.raises(ValueError, match="one name"):
        IO.load_runs(spark, [files["a1"], files["a2"]])
    runs = IO.load_runs(spark, {"first": files["a1"], "second": files["a2"]})
    assert sorted((r.system, r.line_no, r.sys) for r in runs.collect())[:2] == [("first", 0, "The cat on the mat ."), ("first", 1, "A dog over the road .")]
    assert runs.count() == 6
    assert IO.run_names([files["a1"], files["short"]]) == {"a": files["a1"], "short": files["short"]}


def test_evaluate_own_files(spark, files):
    from textlab.operators import evaluation as EV

    ev = IO.eval_files(spark, files["orig"], files["ref"], {"first": files["a1"], "second": files["a2"]})
    assert ev.systems == ("first", "second") and ev.rows.count() == 3
    m = {(r.system, r.metric): r.value for r in EV.metric_table(ev, with_lsum=True).collect()}
    assert m["first", "R-1"] == 100.0 and m["first", "BLEU"] > m["second", "BLEU"] and len(m) == 38


def test_misaligned_files_raise(spark, files):
    with pytest.raises(ValueError, match="not aligned"):
        IO.eval_files(spark, files["orig"], files["ref"], [files["a1"], files["short"]])


def test_convert_and_named_splits(spark, tmp_path):
    base = str(tmp_path)
    src_files = {s: _write(base, f"{s}.source", [f"{s} {i}" for i in range(3)]) for s in IO.SPLITS}
    tgt_files = {s: _write(base, f"{s}.target", [f"t {i}" for i in range(2)]) for s in IO.SPLITS}
    IO.convert_splits(spark, src_files, tgt_files, base)
    rows = IO.read_splits(spark, {s: f"{base}/{s}.json" for s in IO.SPLITS}).collect()
    assert sorted((r.split, r.source, r.target) for r in rows) == sorted((s, f"{s} {i}", f"t {i}") for s in IO.SPLITS for i in range(2))
    with pytest.raises(ValueError, match="json or jsonl"):
        IO.read_splits(spark, {"train": f"{base}/train.csv"})
    with pytest.raises(ValueError, match="splits differ"):
        IO.convert_splits(spark, src_files, {}, base)


def test_pairs_over_gaps_and_long_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "TURN_RANGE", 4)
    turns = [0, 1, 2, 3, 4, 5, 9, 17, 18, 30]
    rows = [(1, t, "user" if i % 2 == 0 else "assistant", f"x{t}") for i, t in enumerate(turns)] + [(2, 7, "assistant", "a"), (2, 9, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.source, r.target) for r in src.conversation_pairs(spark, str(tmp_path)).collect())
    assert got == sorted((f"x{a}", f"x{b}") for a, b in zip(turns[::2], turns[1::2]))


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    rows = [(1, src.PAIR_STRIDE, "user", "a"), (1, src.PAIR_STRIDE + 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    with pytest.raises(Exception, match="too large"):
        src.conversation_pairs(spark, str(tmp_path)).collect()


def test_vocabulary_has_no_cap(spark):
    from textlab.operators import encode as ENC

    toks = spark.range(600).select(F.lit("train").alias("split"), F.col("id").alias("pair_id"),
                                   F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), F.col("id") * 100 + i)).alias("src"),
                                   F.array(F.lit("common")).alias("tgt"))
    v = ENC.vocab_ids(toks)
    n = v.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("d")).first()
    assert (n.n, n.lo, n.hi, n.d) == (60_001, 2, 60_002, 60_001)
    assert v.where("token = 'common'").first().id == 2
    assert ENC.vocab_ids(toks, max_size=10).count() == 10
    assert ENC.encode(toks, v).where(F.array_contains("input_ids", ENC.UNK_ID)).count() == 0


def test_checkpoint_folder_is_required_on_clusters(spark, monkeypatch):
    from textlab import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
