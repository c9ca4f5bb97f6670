"""Documents to sentences, tokens and lemmas.

Segmentation is a chain of regular expressions on one column: a document's
sentences and tokens are generated in the task that reads the document,
without a shuffle.  Only lemmas need a join, on (lang, token).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import scan_bytes
from . import token_kernel as K


def with_arrays(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Add ``sents`` and ``toks`` arrays (one row per document, no explode)."""
    marked = T.mark_sentences(text, lang)
    return docs.select("*", marked.alias("_marked")).select(
        *docs.columns,
        T.sentence_array("_marked").alias("sents"),
        T.token_array("_marked").alias("toks"),
    )


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, para_idx, paragraph) split on exactly two newlines."""
    return T.explode_rows(docs, F.split(F.col(text), "\n\n"), "paragraph", "para_idx", keep=("doc_id",))


def sentences(docs: DataFrame, text: str = "text", lang: str | None = "lang", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """T4/T5: (doc_id, sent_idx, sent); sent_idx is dense from 0."""
    sents = T.sentence_array(T.mark_sentences(text, lang))
    return T.explode_rows(docs, sents, "sent", "sent_idx", keep=tuple(keep))


def tokens(docs: DataFrame, text: str = "text", lang: str | None = "lang", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, token), tokenising each sentence."""
    marked = docs.select(*keep, T.mark_sentences(text, lang).alias("_marked"))
    sents = T.explode_rows(marked.select(*keep, K.sentence_tokens("_marked").alias("_toks")), "_toks", "_sent", "sent_idx", keep=tuple(keep))
    return T.explode_rows(sents, "_sent", "token", "tok_idx", keep=(*keep, "sent_idx"))


BROADCAST_BYTES = 64 << 20   # a dictionary whose inputs are no larger is broadcast


def _broadcast(lemma_dict: DataFrame) -> bool:
    """Whether the dictionary is small enough, by the bytes it is read from; not where broadcasts are switched off."""
    allowed = not str(lemma_dict.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")).startswith("-")
    return allowed and 0 < scan_bytes(lemma_dict) <= BROADCAST_BYTES


def _entries(lemma_dict: DataFrame) -> DataFrame:
    """One lemma for each (lang, token) that has another word as its lemma."""
    d = lemma_dict.groupBy(F.col("lang").alias("_l_lang"), F.col("token").alias("_l_token")).agg(F.min("lemma").alias("_l_lemma"))
    return d.where((F.col("_l_lemma") != "--") & (F.col("_l_lemma") != F.col("_l_token")))


TABLE_ENTRIES = 200_000   # entries of a dictionary that a Python worker holds


def lemma_table(lemma_dict: DataFrame | None) -> dict[str, dict[str, str]] | None:
    """T10 as a table {lang: {token: lemma}}; None if the dictionary is one to join with."""
    if lemma_dict is None:
        return {}
    rows = _entries(lemma_dict).limit(TABLE_ENTRIES + 1).collect() if _broadcast(lemma_dict) else None
    if rows is None or len(rows) > TABLE_ENTRIES:
        return None
    table: dict[str, dict[str, str]] = {}
    for lang, token, lemma in rows:
        table.setdefault(lang, {})[token] = lemma
    return table


def lemma_join(toks: DataFrame, lemma_dict: DataFrame | None, lang: str = "lang") -> DataFrame:
    """Add ``lemma`` by a lookup join on (lang, token).

    A dictionary lemma of ``--`` keeps the token; tokens without an entry
    keep themselves.  There is one path for dictionaries of any size, whose entries that
    change nothing are left out of the join.  Whether it is broadcast is the optimizer's size check, except that
    files of up to BROADCAST_BYTES always are: a join by token would shuffle every token, each frequent word to one task.
    """
    if lemma_dict is None:
        return toks.withColumn("lemma", F.col("token"))
    d = _entries(lemma_dict)
    if _broadcast(lemma_dict):
        d = F.broadcast(d)
    joined = toks.join(d, (toks[lang] == d["_l_lang"]) & (toks["token"] == d["_l_token"]), "left")
    lemma = F.coalesce(F.col("_l_lemma"), F.col("token"))
    return joined.select(*toks.columns, lemma.alias("lemma"))


def lemmas(docs: DataFrame, lemma_dict: DataFrame | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, sent_idx, tok_idx, token, lemma)."""
    toks = tokens(docs, text, lang, keep=("doc_id", lang))
    return lemma_join(toks, lemma_dict, lang).select("doc_id", "sent_idx", "tok_idx", "token", "lemma")


def _by_position(found: str, size: Column) -> Column:
    """An array of ``size`` with the ``l`` of the structs (p, l), sorted by p, at their positions and NULL elsewhere."""
    def nulls(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("string"), n.cast("int"))

    def filled(f: Column) -> Column:
        after = F.transform(f, lambda x, j: F.concat(F.array(x["l"]), nulls(F.coalesce(F.get(f, j + 1)["p"], size) - x["p"] - 1)))
        return F.concat(nulls(F.coalesce(F.get(f, F.lit(0))["p"], size)), F.flatten(after))

    return T.let(found, filled)


def _changed(rows: DataFrame, lemma_dict: DataFrame | None, keys: Sequence[str], tokens: Column, item: Column, lang: str) -> DataFrame:
    """``rows`` and ``_found``, the array of ``item`` (of _pos, token, lemma) for the ``tokens`` whose lemma is another word.

    Of the exploded tokens only those go on, and the first row of each input row, which alone carries the other columns.
    Two rows with one key are an error.
    """
    carry = [c for c in rows.columns if c not in keys]
    # the language is looked at in every row, the rest is kept once
    flat = rows.select(*keys, *carry, F.col(lang).alias("_lang_of"), F.posexplode_outer(tokens).alias("_pos", "token"))
    head = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    flat = flat.select(*keys, "_lang_of", "_pos", "token", F.when(head, F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])).alias("_row"))
    lem = lemma_join(flat, lemma_dict, "_lang_of")
    found = F.col("lemma") != F.col("token")
    lem = lem.where(F.coalesce(found, F.lit(False)) | F.col("_row").isNotNull())
    folded = lem.groupBy(*keys).agg(
        F.count("_row").alias("_rows"), F.first("_row", ignorenulls=True).alias("_row"), F.collect_list(F.when(found, item)).alias("_found"))
    one = F.when(F.col("_rows") > 1, F.raise_error(F.lit("two rows share a key: " + ", ".join(keys))).cast("boolean"))
    return folded.where(one.isNull()).select(*keys, *[F.col(f"_row._{i}").alias(c) for i, c in enumerate(carry)], "_found")


def changed_lemmas(rows: DataFrame, lemma_dict: DataFrame | None, keys: Sequence[str], array: str, out: str, lang: str = "lang") -> DataFrame:
    """T10 for an array of distinct tokens: ``rows`` with ``out``, the structs (t, l) of the tokens t with another lemma l."""
    item = F.struct(F.col("token").alias("t"), F.col("lemma").alias("l"))
    return _changed(rows, lemma_dict, list(keys), F.col(array), item, lang).withColumnRenamed("_found", out)


def fold_lemmas(rows: DataFrame, lemma_dict: DataFrame | None, keys: Sequence[str], arrays: Sequence[str],
                item: Callable[[Column, Column], Column], lang: str = "lang") -> DataFrame:
    """T10 for token arrays: each of ``arrays`` becomes an array of ``item(token, lemma)``, in token order.

    All arrays of a row are exploded together as narrow rows and joined with the dictionary; the lemmas found are put
    back by position.  Rows should be clustered by ``keys`` (then the fold needs no exchange); two rows with one key are
    an error.  Where one of the arrays is NULL all become empty.
    """
    keys, arrays = list(keys), list(arrays)
    carry = [c for c in rows.columns if c not in keys]
    folded = _changed(rows, lemma_dict, keys, F.concat(*arrays), F.struct(F.col("_pos").alias("p"), F.col("lemma").alias("l")), lang)
    folded = folded.withColumn("_found", F.array_sort("_found"))
    sizes = [F.size(F.col(a)) for a in arrays]
    whole = reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in arrays])
    dense = folded.select("*", _by_position("_found", reduce(lambda x, y: x + y, sizes)).alias("_lemmas"))
    out, start = {}, F.lit(1)
    for a, n in zip(arrays, sizes):
        part = F.zip_with(F.col(a), F.slice("_lemmas", start, n), lambda t, m: item(t, F.coalesce(m, t)))
        out[a], start = F.coalesce(F.when(whole, part), F.array()), start + n
    return dense.select(*keys, *[out[c].alias(c) if c in out else F.col(c) for c in carry])


def document_table(docs: DataFrame, lemma_dict: DataFrame | None = None, lang: str = "lang") -> DataFrame:
    """Nested view (doc_id, sents, sents_tokenized, sents_lemmatized).

    The token chain runs once over the marked document and is then cut at
    the sentence marks.  Blank documents have empty arrays.  ``docs`` should be clustered by doc_id.
    """
    marked = docs.select("doc_id", lang, T.mark_sentences("text", lang).alias("m"))
    nested = marked.select("doc_id", lang, T.sentence_array("m").alias("sents"), T.nested_tokens("m").alias("sents_tokenized"))
    nested = nested.withColumn("flat", F.flatten("sents_tokenized"))
    folded = fold_lemmas(nested, lemma_dict, ["doc_id"], ["flat"], lambda token, lemma: lemma, lang)
    sizes = F.transform("sents_tokenized", lambda s: F.size(s))
    folded = folded.select("doc_id", "sents", "sents_tokenized", "flat", T.running_starts(sizes).alias("starts"))
    cut = T.let("flat", lambda flat: F.zip_with("sents_tokenized", F.slice("starts", 1, F.size("sents_tokenized")), lambda s, at: F.slice(flat, at + 1, F.size(s))))
    return folded.select("doc_id", "sents", "sents_tokenized", cut.alias("sents_lemmatized"))
