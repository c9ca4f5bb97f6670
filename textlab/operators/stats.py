"""Vocabularies, document and corpus statistics, novelty, compression.

Per-document statistics are array expressions on the document row: no
token table is materialised and no shuffle happens before the final
(partial + final) aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import cluster
from . import segment as S
from . import token_kernel as K


def vocab(docs: DataFrame, by: Sequence[str] = ("lang",), clean: bool = True) -> DataFrame:
    """A1: (by..., token, cnt).  Partial aggregation absorbs frequent tokens."""
    arr = S.with_arrays(docs.select(*by, "text", *([] if "lang" in by else ["lang"])))
    toks = T.explode_rows(arr, "toks", "token", keep=tuple(by))
    if clean:
        toks = toks.select(*by, T.clean_token("token").alias("token"))
    return toks.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("cnt"))


def text_measures(m: str, lang: str) -> dict[str, F.Column]:
    """What is computed from the raw tokens of one text; ``m`` is the column of :func:`token_kernel.measured`."""
    return {
        **{c: F.col(f"{m}.{c}") for c in ("n_sents", "n_tokens", "sum_token_len")},
        "fre": T.flesch_score(f"{m}.words", f"{m}.syllables", f"{m}.n_sents", lang),
    }


def clean_pair(token: F.Column, lemma: F.Column) -> F.Column:
    """Of a looked-up token: the cleaned token ``t`` and the cleaned lemma ``l``."""
    return F.struct(T.clean_token(token).alias("t"), T.clean_token(lemma).alias("l"))


def doc_table(docs: DataFrame, lemma_dict: DataFrame | None = None, keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """A3-A8 per document plus its distinct types.

    Columns: keys..., n_tokens, n_sents, sum_token_len, avg_token_len,
    avg_sent_len, ttr, fre, types (distinct cleaned tokens), lemma_types
    (distinct cleaned lemmas).  With a dictionary the rows are clustered by the keys, behind the token kernel.
    """
    keys = list(keys)
    lang = [] if "lang" in keys else ["lang"]
    marked = docs.select(*keys, *lang, T.mark_sentences("text", "lang").alias("_marked"))
    arr = marked.select(*keys, *lang, K.measured("_marked", distinct=True).alias("_m"))  # types need each token once
    base = arr.select(*keys, *lang, F.col("_m.toks").alias("toks"), *[c.alias(n) for n, c in text_measures("_m", "lang").items()])
    if lemma_dict is None:  # lemmas are the tokens: cleaned once, no fold
        base = base.withColumn("types", F.array_distinct(T.clean_tokens("toks"))).withColumn("lemma_types", F.col("types"))
    else:
        folded = S.fold_lemmas(cluster(base, *keys).withColumn("_lang", F.col("lang")), lemma_dict, keys, ["toks"], clean_pair, "_lang")
        base = folded.withColumns({"types": F.array_distinct("toks.t"), "lemma_types": F.array_distinct("toks.l")})
    return base.select(
        *keys, "n_tokens", "n_sents", "sum_token_len",
        F.try_divide(F.col("sum_token_len").cast("double"), F.col("n_tokens").cast("double")).alias("avg_token_len"),
        F.try_divide(F.col("n_tokens").cast("double"), F.col("n_sents").cast("double")).alias("avg_sent_len"),
        F.try_divide(F.size("lemma_types").cast("double"), F.col("n_tokens").cast("double")).alias("ttr"),
        "fre", "types", "lemma_types",
    )


def doc_stats(docs: DataFrame, lemma_dict: DataFrame | None = None) -> DataFrame:
    """The six per-document statistics."""
    return doc_table(docs, lemma_dict).select(
        "doc_id", "lang", "n_tokens", "n_sents", "avg_token_len", "avg_sent_len", "ttr", "fre")


def type_counts(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """A2: exact distinct cleaned tokens and lemmas per group.

    Each document contributes its distinct types only; (group, type) pairs
    are de-duplicated with a partial aggregate before the shuffle.
    """
    by = list(by)

    def tagged(col, kind):
        return F.transform(col, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("t")))

    rows = table.select(*by, F.inline_outer(F.concat(tagged("types", "raw"), tagged("lemma_types", "lemma"))))
    return rows.distinct().groupBy(*by).agg(
        F.count_if(F.col("kind") == "raw").alias("types_raw"),
        F.count_if(F.col("kind") == "lemma").alias("types_lemmas"),
    )


SKETCH_BITS = 14                                   # registers of a distinct sketch: 2 ** SKETCH_BITS (16 KB)
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)   # three standard errors, relative


def type_sketches(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """A2, approximate: one mergeable distinct sketch (HyperLogLog) of cleaned tokens and one of lemmas per group.

    A task sends one sketch per group instead of its (group, type) pairs.  Store the result and
    combine slices with :func:`merge_type_sketches`, without a second scan of the texts.
    """
    by = list(by)

    def tagged(col, kind):
        return F.transform(col, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("t")))

    def sketch(kind):
        return F.hll_sketch_agg(F.when(F.col("kind") == kind, F.col("t")), SKETCH_BITS)

    rows = table.select(*by, F.inline_outer(F.concat(tagged("types", "raw"), tagged("lemma_types", "lemma"))))
    return rows.groupBy(*by).agg(sketch("raw").alias("raw_sketch"), sketch("lemma").alias("lemma_sketch"))


def merge_type_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimated distinct counts of the union of the slices in each group; off by SKETCH_ERROR at most (three standard errors)."""
    def estimate(col):
        return F.hll_sketch_estimate(F.hll_union_agg(col))

    return sketches.groupBy(*by).agg(estimate("raw_sketch").alias("types_raw"), estimate("lemma_sketch").alias("types_lemmas"))


def corpus_stats(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """A9-A11 per group, from :func:`doc_table` output, in one pass.

    Each document becomes one "doc" row carrying its statistics plus one
    row per distinct cleaned token / lemma type.  A first aggregate by
    (group, kind, type) de-duplicates types and pre-sums the doc rows (its
    partial, map-side step collapses the one hot (group, "doc") key per
    task); a second one by group counts types and finishes the sums.
    """
    by = list(by)
    num = ["n_tokens", "n_sents", "sum_token_len", "ttr", "fre"]
    values = F.struct(*[F.col(c).cast("double").alias(c) for c in num])
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in num) + ">")
    doc_row = F.array(F.struct(F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("t"), values.alias("v")))

    def type_rows(col, kind):  # narrow: no values
        return F.transform(col, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("t"), none.alias("v")))

    rows = table.select(*by, F.inline(F.concat(doc_row, type_rows("types", "raw"), type_rows("lemma_types", "lemma"))))
    g1 = rows.groupBy(*by, "kind", "t").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"v.{c}").alias(f"s_{c}") for c in num],
        F.count("v.ttr").alias("c_ttr"),
        F.count("v.fre").alias("c_fre"),
    )
    is_doc = F.col("kind") == "doc"

    def doc_sum(c):
        return F.sum(F.when(is_doc, F.col(c)))

    g2 = g1.groupBy(*by).agg(
        doc_sum("n").alias("docs"),
        doc_sum("s_n_tokens").alias("tokens"),
        doc_sum("s_n_sents").alias("sentences"),
        doc_sum("s_sum_token_len").alias("sum_len"),
        doc_sum("s_ttr").alias("sum_ttr"), doc_sum("c_ttr").alias("n_ttr"),
        doc_sum("s_fre").alias("sum_fre"), doc_sum("c_fre").alias("n_fre"),
        F.count_if(F.col("kind") == "raw").alias("types_raw"),
        F.count_if(F.col("kind") == "lemma").alias("types_lemmas"),
    )
    div = F.try_divide
    return g2.select(
        *by,
        F.col("docs").cast("bigint").alias("docs"),
        F.col("tokens").cast("bigint").alias("tokens"),
        F.col("sentences").cast("bigint").alias("sentences"),
        F.col("types_raw").cast("bigint").alias("types_raw"),
        F.col("types_lemmas").cast("bigint").alias("types_lemmas"),
        div(F.col("tokens"), F.col("docs").cast("double")).alias("avg_words"),
        div(F.col("sentences"), F.col("docs").cast("double")).alias("avg_sents"),
        div(F.col("sum_ttr"), F.col("n_ttr").cast("double")).alias("avg_ttr"),
        div(F.col("sum_fre"), F.col("n_fre").cast("double")).alias("avg_fre"),
        div(F.col("sum_len"), F.col("tokens")).alias("avg_word_len"),
        div(F.col("tokens"), F.col("sentences")).alias("avg_sent_len"),
    )


def with_novelty(df: DataFrame, a: str, b: str, ns: Sequence[int] = (1, 2, 3), clean: bool = True) -> DataFrame:
    """A12 for several n: add ``nov_<n>`` (fractions) for token arrays a, b.

    The cleaned arrays are computed once in their own projection and then
    referenced by every n.
    """
    keep = [c for c in df.columns if c not in ("_nov_a", "_nov_b")]
    if clean:
        staged = df.select(*keep, T.clean_tokens(a).alias("_nov_a"), T.clean_tokens(b).alias("_nov_b"))
    else:
        staged = df.select(*keep, F.col(a).alias("_nov_a"), F.col(b).alias("_nov_b"))
    return staged.select(*keep, *[T.novelty("_nov_a", "_nov_b", n, clean=False).alias(f"nov_{n}") for n in ns])


def compression(src_n, tgt_n) -> F.Column:
    """A14 per pair: target tokens / source tokens (NULL when source empty)."""
    return T.ratio(tgt_n, src_n)
