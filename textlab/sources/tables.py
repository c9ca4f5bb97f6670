"""Adapters from the driver's parquet tables to textlab's data model.

documents      -> docs(doc_id, lang, text)
conversations  -> pairs(split, pair_id, source, target): a user turn and the
                  next turn when that one is the assistant's
documents      -> doc_pairs(split, pair_id, source, target): the text and
                  every second sentence of it (a larger paired corpus)
pairs          -> eval(split, pair_id, orig, ref, y0, y1, y2) with the systems
                  identity (= source), gold (= target), lead3 (first three
                  sentences of the source)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# pair_id of a conversation pair = conv_id * PAIR_STRIDE + turn of the user turn;
# ids or turns that would not fit are an error, never a collision.
PAIR_STRIDE = 1048576
TURN_RANGE = 1024            # turns of one conversation that a window sees together
SPLIT_BYTES = 128 << 20      # bytes a task should get


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files (and local rows) that ``df`` reads: the sum over the leaves of its plan.

    The optimizer's estimate of a join is the product of its sides, so it is never asked for
    more than a leaf; a leaf of unknown size counts nothing.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except AttributeError:  # sessions without a JVM handle
        return 0
    return sum(s for s in sizes if s < 1 << 60)


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``: in proportion to the bytes it reads, at least the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * scan_bytes(df) // SPLIT_BYTES))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-partition a *small* file scan by ``key``.

    One file with one row group is one task, whatever the number of cores.
    Below SPLIT_BYTES per shuffle partition the scan is dealt out (a shuffle of at
    most that size); larger scans have enough row groups and are left alone.
    """
    spark = scan.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return scan.repartition(parts, key) if 0 < scan_bytes(scan) < parts * SPLIT_BYTES else scan


def cluster(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys``; the number of partitions follows the size."""
    return df.repartition(partitions_for(df), *keys)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` unchanged; raises if two rows share ``keys``."""
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys).limit(1).collect()
    if twice:
        raise ValueError(f"two rows with the key {twice[0].asDict()}")
    return df


def split_of(key) -> F.Column:
    """Deterministic split: key % 10 == 0 test, 1 val, otherwise train."""
    m = F.pmod(key, F.lit(10))
    return F.when(m == 0, "test").when(m == 1, "val").otherwise("train")


def documents(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    """(doc_id, lang, text); ``clustered``: hash-partitioned by doc_id, for steps that fold rows per document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return cluster(docs, "doc_id") if clustered else spread(docs, "doc_id")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on the driver's data: (split, pair_id, source, target).

    A user turn and the next turn of its conversation, if that is the
    assistant's (turn numbers may have gaps).  A window sees TURN_RANGE
    turn numbers of a conversation, so one very long conversation spreads
    over many tasks; the first row of each range is also dealt to the range
    before it.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv = conv.withColumn("range", F.floor(F.col("turn") / TURN_RANGE))
    firsts = conv.groupBy("conv_id", "range").agg(F.min("turn").alias("turn"))  # one row per TURN_RANGE turns
    order = Window.partitionBy("conv_id").orderBy("range")
    joints = firsts.select("conv_id", "turn", F.lag("range").over(order).alias("before")).where("before IS NOT NULL")
    rows = conv.join(joints, ["conv_id", "turn"], "left")
    rows = rows.withColumn("range", F.explode(F.array_compact(F.array("range", "before"))))
    n = partitions_for(conv)
    rows = rows.repartition(n, "conv_id", "range")
    w = Window.partitionBy("conv_id", "range").orderBy("turn")
    nxt = rows.select("conv_id", "turn", "role", "range", "before", F.col("text").alias("source"),
                      F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("target"))
    # the copy in the range before is the last row there and has no next row
    pairs = nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    fits = F.col("turn").between(0, PAIR_STRIDE - 1) & (F.abs("conv_id") < (1 << 63) // PAIR_STRIDE - 1)
    pair_id = F.when(fits, F.col("conv_id") * PAIR_STRIDE + F.col("turn")).otherwise(
        F.raise_error(F.lit("conv_id or turn too large for a pair_id")).cast("bigint"))
    return pairs.select(split_of(F.col("conv_id")).alias("split"), pair_id.alias("pair_id"), "source", "target")


def document_pairs(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    """Larger paired corpus: source = document, target = its odd sentences."""
    docs = documents(spark, sf_dir, clustered)
    sents = T.sentence_array(T.mark_sentences("text", "lang"))
    target = F.array_join(F.filter(sents, lambda s, i: i % 2 == 0), " ")
    return docs.select(
        split_of(F.col("doc_id")).alias("split"),
        F.col("doc_id").alias("pair_id"),
        F.col("lang"),
        F.col("text").alias("source"),
        target.alias("target"),
    )


def lead_sentences(text, k: int = 3) -> F.Column:
    """The first k sentences (T8 rule), joined by a space."""
    sents = T.sentence_array(T.plain_marked_sentences(text))
    return F.array_join(F.slice(sents, 1, k), " ")


STAND_IN_SYSTEMS = ("identity", "gold", "lead3")


def stand_in_outputs(pairs: DataFrame) -> DataFrame:
    """(split, pair_id, orig, ref, y0, y1, y2): each pair with the outputs of the stand-in systems."""
    return pairs.select("split", "pair_id", F.col("source").alias("orig"), F.col("target").alias("ref"),
                        F.col("source").alias("y0"), F.col("target").alias("y1"), lead_sentences(F.col("source")).alias("y2"))
