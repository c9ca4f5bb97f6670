"""Registered queries of the training-data operators (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import zlib

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import (byte_bpe, decontam, fill_middle, lm, ngram_join, oracle, order_minhash, packing, periodic_runs, pii, quality, sharding, suffix_dedup,
               token_counts)

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {"op7_suffix_merge": oracle.repeated_bytes(), "op10_ngram_join": oracle.ngram_components()}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


@query("op1_rule_quality")
def op1(spark, sf) -> DataFrame:
    return quality.quality_scores(C.read_documents(spark, sf), C.read_table(spark, sf, "labels"))


@query("op2_skip_chain_pii")
def op2(spark, sf) -> DataFrame:
    return pii.personal_data(C.read_documents(spark, sf))


@query("op3_pack_ffd")
def op3(spark, sf) -> DataFrame:
    return packing.pack_documents(C.read_documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_gated_lm")
def op4(spark, sf) -> DataFrame:
    return lm.document_scores(C.read_documents(spark, sf))


@query("op5_cgk_decontam")
def op5(spark, sf) -> DataFrame:
    return decontam.leaks(C.read_documents(spark, sf), C.read_table(spark, sf, "benchmark"))


@query("op6_ring_shards")
def op6(spark, sf) -> DataFrame:
    x = sharding.ring_shards(C.read_documents(spark, sf), n_shards=40)
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "home_shard")


@query("op7_suffix_merge")
def op7(spark, sf) -> DataFrame:
    return suffix_dedup.repeated_bytes(C.read_documents(spark, sf))


@query("op8_order_minhash")
def op8(spark, sf) -> DataFrame:
    return order_minhash.fingerprints(C.read_documents(spark, sf))


@query("op9_transducer_tokens")
def op9(spark, sf) -> DataFrame:
    return token_counts.token_counts(C.read_documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op10_ngram_join")
def op10(spark, sf) -> DataFrame:
    return ngram_join.ngram_components(C.read_documents(spark, sf), k=4, num=85, den=100)


@query("op11_wavelet_fim")
def op11(spark, sf) -> DataFrame:
    x = fill_middle.fill_in_middle(C.read_documents(spark, sf), seed=1, plain_percent=10, spm_percent=20)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def repeat_tail(key: str, words: list[bytes]) -> list[bytes]:
    """In one text of ten the words from some place on repeat with some period; both follow from the id."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op12_automaton_runs")
def op12(spark, sf) -> DataFrame:
    x = periodic_runs.periodic_runs(C.read_documents(spark, sf), rewrite=repeat_tail)
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent,
                    periodic_runs.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_transducer_bpe")
def op13(spark, sf) -> DataFrame:
    return byte_bpe.round_trip(C.read_documents(spark, sf), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
