"""T5: abbreviations learned from the corpus, without a list.

A word that nearly always has a full stop behind it is an abbreviation, the more
so the shorter it is and the more full stops stand inside of it.  The score of a type is the log-likelihood ratio
(Dunning) of "a full stop follows with probability 0.99" against "as after
any word", times the factors of Kiss and Strunk (2006):

    exp(-letters) * (inner full stops + 1) * letters ** -(occurrences without a full stop)

Words are runs of letters with single full stops between letters.  Counting is one aggregate per
(lang, surface form) with partial aggregation; all that follows works on types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The published probability and threshold.
STOP_PROBABILITY = 0.99
THRESHOLD = 0.3

WORD = r"\p{L}+(?:\.\p{L}+)*\.?"


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, form, type, n_stop, n_plain): occurrences of every surface form with and without a full stop behind it."""
    d = docs.select(F.col(lang).alias("lang"), F.regexp_extract_all(F.col(text), F.lit(WORD), 0).alias("w"))
    words = T.explode_rows(d, "w", "word", keep=("lang",))
    stop = F.endswith("word", F.lit("."))
    form = F.when(stop, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    counts = words.groupBy("lang", form.alias("form")).agg(F.count_if(stop).alias("n_stop"), F.count_if(~stop).alias("n_plain"))
    return counts.select("lang", "form", F.lower("form").alias("type"), "n_stop", "n_plain")


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(lang, type, n_stop, n_plain, score, forms) of the types whose score reaches ``threshold``;
    ``forms``: how they are written before a full stop, sorted."""
    counts = word_counts(docs, lang, text)
    totals = counts.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n_stop").alias("stops"), F.sum(F.col("n_stop") + F.col("n_plain")).alias("words"))
    types = counts.groupBy("lang", "type").agg(
        F.sum("n_stop").alias("n_stop"), F.sum("n_plain").alias("n_plain"), F.array_sort(F.collect_list(F.when(F.col("n_stop") > 0, F.col("form")))).alias("forms"))
    k, r, p = F.col("n_stop"), F.col("n_plain"), F.col("stops") / F.col("words")
    x = types.where(k > 0).join(totals, F.col("lang").eqNullSafe(F.col("_lang"))).where("stops < words")
    ratio = 2 * (k * (F.log(F.lit(STOP_PROBABILITY)) - F.log(p)) + r * (F.log(F.lit(1 - STOP_PROBABILITY)) - F.log(1 - p)))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("type") - letters
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -r.cast("double"))
    return x.withColumn("score", score).where(F.col("score") >= threshold).select("lang", "type", "n_stop", "n_plain", "score", "forms")


def patterns(learned: DataFrame) -> DataFrame:
    """(lang, abbr_pattern): one regular expression per language, longer forms first.

    The list is short by nature: exp(-letters) asks for a likelihood ratio that grows
    with e for each letter.
    """
    forms = T.explode_rows(learned, "forms", "form", keep=("lang",))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("n"), "form"))), lambda s: F.replace(s["form"], F.lit("."), F.lit("\\.")))
    return forms.groupBy("lang").agg(F.concat(F.lit(r"(^|[^\p{L}])("), F.array_join(ordered, "|"), F.lit(r")\.")).alias("abbr_pattern"))


def marked_sentences(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """``docs`` (lang, text, ...) with ``marked``: sentences by the rules (T4) and the learned list of each language."""
    p = patterns(learned)
    x = docs.join(p.withColumnRenamed("lang", "_abbr_lang"), F.col("lang").eqNullSafe(F.col("_abbr_lang")), "left").drop("_abbr_lang")
    return x.withColumn("marked", T.mark_sentences("text", "lang", learned=F.col("abbr_pattern"))).drop("abbr_pattern")


def sentences(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sent) with the learned list."""
    return T.explode_rows(marked_sentences(docs, learned), T.sentence_array("marked"), "sent", "sent_idx", keep=("doc_id",))
