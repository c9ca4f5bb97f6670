"""Physical-plan properties that the scale design relies on."""

import contextlib
import io
import os
import re

import pytest

import __spark_entry__ as E
from textlab.operators import sections as SEC
from textlab.operators import segment as S
from textlab.sources import lexicon
from textlab.sources import tables as src

SF = "/root/testdata/sf0.001"


def text_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plan(spark, name) -> str:
    return text_of(E.queries()[name](spark, SF))


def exchanges(p: str) -> list[str]:
    return re.findall(r"Arguments: (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition)", p)


@pytest.fixture
def large_input(monkeypatch):
    """Scans that count as large: no dealing out of small files."""
    monkeypatch.setattr(src, "SPLIT_BYTES", 1)


def test_doc_stats_one_exchange_no_inferred_filter(spark):
    p = plan(spark, "doc_stats")
    # only the small scan's repartition by doc_id; statistics are row expressions
    assert len(exchanges(p)) <= 1
    assert "Condition : (size(" not in p and "Condition : ((size(" not in p


@pytest.mark.parametrize("name", ["sentences", "tokens", "eval_tokens", "doc_stats", "sections", "next_section", "text_cleanup", "newline_sentences"])
def test_row_operators_need_no_exchange_on_large_inputs(spark, large_input, name):
    p = plan(spark, name)
    assert exchanges(p) == [] and "Window" not in p


def test_sections_have_no_window(spark):
    p = text_of(SEC.sections(src.read_table(spark, SF, "documents")))
    assert "Window" not in p and exchanges(p) == []


def test_partitions_follow_the_size(spark, monkeypatch):
    docs = src.read_table(spark, SF, "documents")
    assert src.partitions_for(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(src, "SPLIT_BYTES", 10_000)
    assert src.partitions_for(docs) > 50


def repartitions(p: str) -> list[int]:
    """Partition numbers of the exchanges that a plan fixes itself."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", p)]


@pytest.mark.parametrize("name", ["metric_means", "evaluate_runs", "corpus_report", "encode_pairs", "rouge_lsum"])
def test_exchanges_follow_the_bytes_read(spark, monkeypatch, name):
    """Sized by the files read, not by a join's estimate (the product of its sides): a
    few tasks on small tables, and in proportion to the input."""
    def largest(sf):
        return max(repartitions(text_of(E.queries()[name](spark, sf))))

    small, large = SF, SF.replace("0.001", "0.01")
    assert largest(large) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(src, "SPLIT_BYTES", 2_000)
    sizes = [os.path.getsize(f"{sf}/conversations.parquet") for sf in (small, large)]
    growth = largest(large) / largest(small)
    assert 0.3 * sizes[1] / sizes[0] < growth < 1.5 * sizes[1] / sizes[0]


def test_document_table_shuffles_documents_not_tokens(spark):
    p = text_of(S.document_table(src.documents(spark, SF, clustered=True), lexicon.builtin_lemmas(spark)))
    keyed = [e for e in exchanges(p) if e.startswith("hashpartitioning")]
    assert sum("doc_id" in e for e in keyed) == 1 and len(keyed) == 2  # the other one is the dictionary's own
    assert "BroadcastHashJoin" in p


def test_ngram_counts_not_shuffled_by_gram(spark):
    p = plan(spark, "metric_means")
    for e in exchanges(p):
        assert "gram" not in e
    # per-system results are the only aggregate exchanges
    assert any(e.startswith("hashpartitioning(system") for e in exchanges(p))


def test_vocab_partial_aggregation(spark):
    assert "partial_count" in plan(spark, "vocab")


def test_vocabulary_numbering_has_no_single_task_window(spark):
    """Only the starts of the ranges (one row each) meet in one task."""
    p = plan(spark, "vocab_ids")
    assert "cnt" not in " ".join(re.findall(r"\(\d+\) Window\n.*?\n\n", p, re.S)).replace("count", "")
