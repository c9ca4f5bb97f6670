"""Line files, JSON lines, system runs and metric sinks.

Line identity is positional in the reference; here a line number is given
once at load and carried as a key.  Numbering is distributed: each input
split's rows keep their order inside the split, the per-split row counts
(one row per split) give the offsets, and a join on the split adds them.
Nothing goes through the driver and no task sees more than its split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators.evaluation import Eval
from ..session import scratch_path

SPLITS = ("train", "val", "test")
PAIR_SCHEMA = Ty.StructType([
    Ty.StructField("source", Ty.StringType(), True),
    Ty.StructField("target", Ty.StringType(), True),
])


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(line_no, line) for every line of one file, or of one table
    that Spark wrote as a folder of part files (in name order).

    Lines split on \\n, \\r\\n and \\r; ``strip`` removes surrounding
    whitespace as Python's ``str.strip``.  ``line_no`` counts from 0.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value").alias("line"),
    )
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid0"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    offsets = blocks.select("file", "block", "mid0", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("start")).join(files, "file")
    lines = raw.join(offsets, ["file", "block"])  # broadcast if the splits are few: the optimizer checks the size
    line = T.strip("line") if strip else F.col("line")
    return lines.select((F.col("file_start") + F.col("start") + F.col("mid") - F.col("mid0")).alias("line_no"), line.alias("line"))


def read_labelled(spark: SparkSession, paths: Mapping[str, str], label: str) -> DataFrame:
    """(label, line_no, line) of several files, each numbered from 0."""
    parts = [read_lines(spark, path).select(F.lit(name).alias(label), "line_no", "line") for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def write_lines(df: DataFrame, path: str, text: str, order: str, mode: str = "overwrite") -> None:
    """One line per row in key order; embedded line breaks become spaces.

    Range partitioning on the key + sorting within partitions gives part
    files that are each sorted and ordered among themselves.
    """
    clean = F.regexp_replace(F.col(text), "\r\n|\r|\n", " ")
    out = df.select(order, clean.alias("value")).repartitionByRange(order).sortWithinPartitions(order)
    out.select("value").write.mode(mode).text(path)


def pair_lines(src: DataFrame, tgt: DataFrame, keys: Sequence[str] = ("line_no",)) -> DataFrame:
    """Pair two line tables by position; the longer one is truncated
    (an inner equi-join).  With several splits the keys are (split, line_no)."""
    keys = list(keys)
    s = src.select(*keys, F.col("line").alias("source"))
    t = tgt.select(*keys, F.col("line").alias("target"))
    return s.join(t, keys, "inner").withColumnRenamed("line_no", "pair_id").select(*[k for k in keys if k != "line_no"], "pair_id", "source", "target")


def convert_splits(spark: SparkSession, sources: Mapping[str, str], targets: Mapping[str, str], path: str) -> None:
    """Line files of the splits -> one JSON-lines table per split, ``path``/<split>.json."""
    if set(sources) != set(targets):
        raise ValueError(f"splits differ: {sorted(sources)} and {sorted(targets)}")
    for split in sources:
        pairs = pair_lines(read_lines(spark, sources[split]), read_lines(spark, targets[split]))
        write_jsonl(pairs.repartitionByRange("pair_id").sortWithinPartitions("pair_id").select("pair_id", "source", "target"), f"{path}/{split}.json")


def write_jsonl(pairs: DataFrame, path: str) -> None:
    """S3: JSON lines; nulls kept, not dropped."""
    pairs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, extra: Ty.StructType | None = None) -> DataFrame:
    """JSON lines with an explicit schema (no inference)."""
    schema = PAIR_SCHEMA if extra is None else Ty.StructType(list(extra.fields) + list(PAIR_SCHEMA.fields))
    return spark.read.schema(schema).json(path)


def read_splits(spark: SparkSession, paths: Mapping[str, str], extra: Ty.StructType | None = None) -> DataFrame:
    """Named split files, stacked with a ``split`` column.  The format
    follows from the extension, which must be json or jsonl for every split."""
    for split, path in paths.items():
        ext = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)
        if len(ext) < 2 or ext[1] not in ("json", "jsonl"):
            raise ValueError(f"{split}: {path} should be a json or jsonl file")
    parts = [read_jsonl(spark, path, extra).withColumn("split", F.lit(split)) for split, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def run_names(paths: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """Name -> path; without explicit names the parent directory's name.
    Two runs with one name are an error (name them explicitly)."""
    if isinstance(paths, Mapping):
        return dict(paths)
    names = [p.rstrip("/").split("/")[-2] if "/" in p.rstrip("/") else "" for p in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"several runs have one name: {sorted(names)}")
    return dict(zip(names, paths))


def load_runs(spark: SparkSession, paths: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """(system, line_no, sys); one run per path."""
    return read_labelled(spark, run_names(paths), "system").withColumnRenamed("line", "sys")


def alignment_counts(orig: DataFrame, ref: DataFrame, runs: DataFrame) -> DataFrame:
    """Per system, line counts of orig, ref and sys and whether they agree.

    Line numbers are dense from 0 by construction, so equal counts mean
    aligned files.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    totals = count(orig, "n_orig").join(count(ref, "n_ref"), "_k")  # one row each
    per_sys = runs.groupBy("system").agg(F.count(F.lit(1)).alias("n_sys")).withColumn("_k", F.lit(1))
    aligned = (F.col("n_orig") == F.col("n_ref")) & (F.col("n_orig") == F.col("n_sys"))
    return per_sys.join(totals, "_k").select("system", "n_orig", "n_ref", "n_sys", aligned.alias("aligned"))


def check_aligned(orig: DataFrame, ref: DataFrame, runs: DataFrame) -> None:
    """Raises unless orig, ref and every run have as many lines."""
    bad = [r.asDict() for r in alignment_counts(orig, ref, runs).where(~F.col("aligned")).limit(20).collect()]
    if bad:
        raise ValueError(f"files are not aligned: {bad}")


def eval_files(spark: SparkSession, orig: str, ref: str, runs: Sequence[str] | Mapping[str, str]) -> Eval:
    """Originals, references and any number of runs joined by line number, after the alignment check."""
    named = run_names(runs)
    o, r = read_lines(spark, orig), read_lines(spark, ref)
    sys = {name: read_lines(spark, path) for name, path in named.items()}
    check_aligned(o, r, load_runs(spark, named))
    rows = o.withColumnRenamed("line", "orig").join(r.withColumnRenamed("line", "ref"), "line_no")
    for i, lines in enumerate(sys.values()):
        rows = rows.join(lines.withColumnRenamed("line", f"y{i}"), "line_no")
    rows = rows.select(F.lit("").alias("split"), F.col("line_no").alias("pair_id"), "orig", "ref", *[f"y{i}" for i in range(len(sys))])
    return Eval(rows, tuple(named))


METRICS_SCHEMA = "system string, metric string, value double, run string, prefix string"


def save_metrics(metrics: DataFrame, path: str, prefix: str, samples: int | None = None, run: str = "run") -> None:
    """(run, prefix, system, metric, value) rows of a metrics table; ``samples`` adds the row
    ``{prefix}_samples`` for every system.

    The table is partitioned by (run, prefix) and a write replaces its own partition only: other
    runs and prefixes stay, and a rerun or a retry leaves one copy.
    """
    if not run or not prefix:
        raise ValueError("run and prefix must not be empty")
    rows = metrics.select("system", "metric", F.col("value").cast("double").alias("value"))
    if samples is not None:
        rows = rows.unionByName(metrics.select("system").distinct().select(
            "system", F.lit(f"{prefix}_samples").alias("metric"), F.lit(float(samples)).alias("value")))
    rows = rows.select("system", "metric", "value", F.lit(run).alias("run"), F.lit(prefix).alias("prefix"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "prefix").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(system, metric, value, run, prefix) of all saved runs."""
    return spark.read.schema(METRICS_SCHEMA).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
