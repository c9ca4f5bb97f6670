"""Session and scratch-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "textlab", **conf: str) -> SparkSession:
    """A session with AQE on and the UI off; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Executors of a cluster do not see the driver's local folders, so a
    session without the setting is an error there; only a local session (one
    machine, as in tests) gets a fresh folder under the system temp dir.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext handle: the session conf is all we have
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="textlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def _session_folder(spark: SparkSession) -> str:
    """This session's own folder below the checkpoint folder."""
    name = spark.conf.get("textlab.scratch", None)
    if not name:
        name = uuid.uuid4().hex
        spark.conf.set("textlab.scratch", name)
    return f"{checkpoint_dir(spark).rstrip('/')}/textlab/{name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the session's folder for a written table."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> None:
    """Remove the written intermediates of this session (when no result that reads them is needed any more)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "table"):
    """Cut lineage: write a table below the shared checkpoint folder and read
    it back.

    Used for small intermediates read by several branches (a vocabulary, a
    decoded evaluation table, a report before formatting): they are computed
    once, and a lost executor re-reads files instead of recomputing.  (An
    eager ``checkpoint()`` would compute the plan twice: once to count and
    once to write.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
