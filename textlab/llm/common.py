"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

__all__ = ["read_documents", "read_table", "id_fold", "text_or_empty", "words_of", "id_filter", "give_back", "materialize"]

FILTER_BITS = 1 << 24  # of an id_filter, whatever the input


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_fold(doc_id: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the runs of characters other than space and
    U+0009..U+000D, as UTF-8 (bytes.lower and bytes.split do exactly this)."""
    return text.encode().lower().split() if text else []


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system.

    Workers are reused and take turns, so without it each of them keeps what the largest of all stages needed.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def id_filter(ids: DataFrame, col: str):
    """Column -> Column: True for all values in ``ids``, False for nearly all others.

    A bitmap of hashes with FILTER_BITS bits, built by Spark and broadcast: it keeps
    texts that a following exact join would drop out of the shuffle.
    """
    bit = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    maps = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    bits = np.zeros(FILTER_BITS, np.uint8)
    for r in maps.collect():  # FILTER_BITS / 32768 rows at most
        part = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little")
        bits[((r.k - 1) * len(part) + 1 + np.flatnonzero(part)) % FILTER_BITS] = 1
    held = ids.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def in_map(pos: pd.Series) -> pd.Series:
        p = pos.to_numpy()
        return pd.Series((held.value[p >> 3] >> (7 - (p & 7))) & 1 == 1)

    return lambda c: in_map(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)))
