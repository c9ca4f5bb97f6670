"""Corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are written
as Parquet below the shared checkpoint folder and read again, so each stage starts from
files and a lost executor costs no more than its own tasks.

Defined results: rows with a null id stay unless another rule removes them; an empty or null
text has no shingles, leaks nothing and is packed as its end token if the
quality rules keep it; repeated rows of one id and text are one document; empty tables pass through
as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import decontam, ngram_join, packing, pii, quality
from textlab.llm.common import materialize, read_documents, read_table

#: No SQL: boosted rules, belief propagation and bin packing are tested against brute-force versions.
ORACLE_SQL = None
#: Words whose ids a worker keeps: executors have grown in the stages before, and up to four workers of each take turns.
TABLE_WORDS = 150_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rule ensemble does not reject."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles at 0.8.

    A document is an id and a text: other texts of the id stay.  Of several texts of the smallest id, one stays.
    Further columns pass through under any name.
    """
    mark = "text_hash"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.xxhash64("text"))
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(mark).alias("hash")).alias("doc_id"), "text")
    groups = ngram_join.ngram_components(keyed, k=5, num=80, den=100)
    copies = groups.filter("component_id <> doc_id and not doc_id.no_id").select("doc_id.doc_id", F.col("doc_id.hash").alias(mark)).distinct()
    return rows.join(copies, ["doc_id", mark], "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), table_words=TABLE_WORDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("personal data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
