"""One lemma path for dictionaries of any size; stacked splits keep their rows; duplicate keys are errors."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import segment as S
from textlab.operators import stats as A
from textlab.plans import corpus_report as CR
from textlab.sources import lexicon
from textlab.sources import tables as src

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def _large(spark):
    """The built-in dictionary among 100,000 entries that no text holds."""
    more = spark.range(100_000).select(F.lit("en").alias("lang"), F.concat(F.lit("\u0001w"), F.col("id")).alias("token"), F.lit("x").alias("lemma"))
    return lexicon.builtin_lemmas(spark).unionByName(more)


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_result_does_not_depend_on_dictionary_size(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        docs = src.documents(spark, SF, clustered=True)
        pairs = src.conversation_pairs(spark, SF)
        small, large = lexicon.builtin_lemmas(spark), _large(spark)
        cols = ["doc_id", "n_tokens", "n_sents", "avg_token_len", "ttr", "fre"]
        assert _rows(A.doc_table(docs, small).select(*cols)) == _rows(A.doc_table(docs, large).select(*cols))
        assert _rows(CR.corpus_report(pairs, small)) == _rows(CR.corpus_report(pairs, large))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stacked_splits_keep_their_pairs(spark):
    pairs = spark.createDataFrame([("train", 0, "A b c d. E f.", "A b."), ("val", 0, "G h i j k l m n o p.", "G h i j k l m n o.")],
                                  "split string, pair_id long, source string, target string")
    for dictionary in (lexicon.builtin_lemmas(spark), _large(spark), None):
        rep = {r.statistic: r for r in CR.corpus_report(pairs, dictionary).collect()}
        assert rep["Docs"].source == rep["Docs"].target == 2
        assert rep["CMP"].target == pytest.approx((3 / 8 + 10 / 11) / 2)


def test_duplicate_keys_are_errors(spark):
    pairs = spark.createDataFrame([("train", 0, "A b.", "A."), ("train", 0, "C d.", "C.")], "split string, pair_id long, source string, target string")
    with pytest.raises(Exception, match="two rows share a key"):
        CR.corpus_report(pairs, lexicon.builtin_lemmas(spark)).collect()
    with pytest.raises(ValueError, match="two rows"):
        src.require_unique(pairs, "split", "pair_id")


def test_blank_documents_stay(spark):
    docs = spark.createDataFrame([(1, "en", "One two. Three."), (2, "en", "  "), (3, "en", "")], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in S.document_table(docs, lexicon.builtin_lemmas(spark)).collect()}
    assert set(got) == {1, 2, 3} and got[2].sents == [] and got[3].sents_lemmatized == []
    assert got[1].sents_tokenized == [["One", "two", "."], ["Three", "."]]
