"""T10 for words outside the dictionary: suffix edit rules learned from its entries.

An entry (token, lemma) that shares a beginning is an edit: the letters behind the common
beginning change.  Read with up to ``CONTEXT`` letters before the edit it gives rules "suffix -> replacement",
entries that do not change included.  Of the replacements of a suffix the one with most votes is kept if it has more than
half of them (and ``support`` votes at least).  A word takes the rule with the longest suffix that leaves
``STEM`` letters or more; without a rule it keeps its form.

Rules are one aggregate over the dictionary; the words to look up are the corpus's types, not its tokens.  ``extended``
gives a dictionary again, so every operator with a ``lemma_dict`` takes it unchanged.

Defined results: entries with a null, an empty side or the lemma ``--`` give no rules; only words of letters get a guess;
repeated entries count once; a null language has no rules; an empty dictionary gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONTEXT = 3   # letters before the edit that a rule may ask for
LONGEST = 8   # letters of a suffix
STEM = 2      # letters that a rule leaves untouched
SUPPORT = 2   # entries that must agree

_WORD = r"^\p{L}+$"


def learn(lemma_dict: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, suffix, replacement, votes, total) of the rules that hold, one per language and suffix."""
    d = lemma_dict.where("lang is not null and length(lemma) > 0 and lemma <> '--'").where(F.rlike("token", F.lit(_WORD))).select("lang", "token", "lemma").distinct()
    size = F.length("token")
    common = F.expr("size(filter(sequence(1, least(length(token), length(lemma))), i -> left(token, i) = left(lemma, i)))")
    d = d.withColumn("size", size).withColumn("common", common).where("common > 0")
    least, most = F.greatest(F.lit(1), F.col("size") - F.col("common")), F.least(F.col("size") - 1, F.lit(LONGEST), F.col("size") - F.col("common") + CONTEXT)
    rules = T.explode_rows(d.where(least <= most).withColumn("cuts", F.sequence(least, most)), "cuts", "cut", keep=("lang", "token", "lemma", "size"))
    rules = rules.select("lang", F.expr("right(token, cut)").alias("suffix"), F.expr("substring(lemma, size - cut + 1)").alias("replacement"))
    votes = rules.groupBy("lang", "suffix", "replacement").agg(F.count("*").alias("votes"))
    best = votes.groupBy("lang", "suffix").agg(F.max(F.struct("votes", "replacement")).alias("best"), F.sum("votes").alias("total"))
    return best.select("lang", "suffix", "best.replacement", "best.votes", "total").where(F.col("votes") >= support).where("2 * votes > total")


def guess(types: DataFrame, rules: DataFrame) -> DataFrame:
    """(lang, token, lemma, suffix) of the types (lang, token) for which a rule holds."""
    words = types.select("lang", "token").where(F.rlike("token", F.lit(_WORD))).where(F.length("token") > STEM)
    cuts = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("token") - STEM))
    ends = T.explode_rows(words.withColumn("suffixes", F.transform(cuts, lambda n: F.right("token", n))), "suffixes", "suffix", keep=("lang", "token"))
    found = ends.select("lang", "token", "suffix").join(rules.select("lang", "suffix", "replacement"), ["lang", "suffix"])
    best = found.groupBy("lang", "token").agg(F.max_by(F.struct("suffix", "replacement"), F.length("suffix")).alias("r"))
    return best.select("lang", "token", F.expr("concat(left(token, length(token) - length(r.suffix)), r.replacement)").alias("lemma"), F.col("r.suffix").alias("suffix"))


def extended(types: DataFrame, lemma_dict: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lemma_dict`` with guesses for the types (lang, token) that it lacks."""
    entries = lemma_dict.select("lang", "token", "lemma")
    unknown = types.select("lang", "token").distinct().join(entries.select("lang", "token"), ["lang", "token"], "left_anti")
    return entries.unionByName(guess(unknown, learn(lemma_dict, support)).select("lang", "token", "lemma"))
