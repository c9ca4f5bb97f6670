"""A23 paired corpus report (with A9-A14, P6, P7).

pairs(split, pair_id, source, target[, lang]) -> one row per pair with the
tokens and lemmas of both sides -> "doc", "pair" and "type" rows -> aggregates
by side.  Splits are stacked: a pair is known by (split, pair_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import segment as S
from ..operators import stats as A
from ..operators import token_kernel as K
from ..sources.tables import cluster

STAT_COLUMNS = [(name, column) for name, _, column in R.CORPUS_REPORT_ROWS]
PAIR = ["split", "pair_id"]
SIDES = (("source", "s"), ("target", "t"))
NUM = ["n_tokens", "n_sents", "sum_token_len", "ttr", "fre", "nov_1", "nov_2", "nov_3", "cmp"]


def pair_table(pairs: DataFrame, lemma_dict: DataFrame | None = None, default_lang: str = "en") -> DataFrame:
    """One row per pair: for both sides (s_, t_) the measures n_tokens, n_sents,
    sum_token_len, fre, n_types and the arrays raw and lem (distinct cleaned tokens and
    lemmas); novelty nov_1..nov_3 of target against source lemmas; cmp.
    """
    return _one_each(_pairs(pairs, lemma_dict, default_lang))


def _pairs(pairs: DataFrame, lemma_dict: DataFrame | None, default_lang: str = "en", once: bool = False) -> DataFrame:
    """As :func:`pair_table`, without a look at the keys.  ``once``: ``types`` instead of the four arrays, structs
    (t, kinds) as :meth:`textlab.operators.token_kernel.Pairs.new_types` gives them; a task may give a type once for all its pairs.

    A dictionary that fits into a Python worker goes to a kernel that sees both texts of a pair: no token leaves it.
    Larger ones are joined: see :func:`_joined_pairs`.
    """
    lang = F.col("lang") if "lang" in pairs.columns else F.lit(default_lang)
    p = pairs.select(*PAIR, lang.alias("lang"), "source", "target")
    marked = p.select(*PAIR, "lang", *[T.mark_sentences(side, "lang").alias(x) for side, x in SIDES])
    table = S.lemma_table(lemma_dict)
    if table is None:
        out = _joined_pairs(marked, lemma_dict)
        if once:
            out = out.withColumn("types", F.concat(*[_typed(f"{x}_{c}", kind * side) for side, (_, x) in zip((1, 4), SIDES) for c, kind in (("raw", K.RAW), ("lem", K.LEMMA))]))
    else:
        found = marked.select(*PAIR, "lang", K.paired("lang", "s", "t", pairs.sparkSession.sparkContext.broadcast(table), once).alias("_c"))
        measures = {x: F.struct(*[F.col(f"_c.{x}_{c}").alias(c) for c in K.MEASURES]) for _, x in SIDES}
        found = found.withColumns({f"{x}_m": m for x, m in measures.items()})
        out = found.select(*PAIR, "lang", *[c.alias(f"{x}_{n}") for _, x in SIDES for n, c in A.text_measures(f"{x}_m", "lang").items()],
                           *[f"_c.{x}_n_types" for _, x in SIDES], *[f"_c.nov_{n}" for n in (1, 2, 3)],
                           *([F.arrays_zip(F.col("_c.types").alias("t"), F.col("_c.kinds").alias("kinds")).alias("types")] if once
                             else [f"_c.{x}_{c}" for _, x in SIDES for c in ("raw", "lem")]))
    return out.withColumn("cmp", A.compression("s_n_tokens", "t_n_tokens"))


def _joined_pairs(marked: DataFrame, lemma_dict: DataFrame | None) -> DataFrame:
    """Pairs are clustered by (split, pair_id) once, behind the token kernel; the fold of
    the looked-up tokens then needs no exchange.
    """
    arr = marked.select(*PAIR, "lang", *[K.measured(x).alias(f"{x}_m") for _, x in SIDES])
    measured = arr.select(*PAIR, "lang", *[F.col(f"{x}_m.toks").alias(f"{x}_toks") for _, x in SIDES],
                          *[c.alias(f"{x}_{n}") for _, x in SIDES for n, c in A.text_measures(f"{x}_m", "lang").items()])
    # each token of a pair is looked up once; those with another lemma go on
    types = cluster(measured, *PAIR).withColumn("_types", F.array_distinct(F.concat(*[f"{x}_toks" for _, x in SIDES])))
    out = S.changed_lemmas(types, lemma_dict, PAIR, "_types", "_changed")
    out = out.withColumn("_c", K.compared(*[f"{x}_toks" for _, x in SIDES], "_changed")).drop("_types", "_changed", *[f"{x}_toks" for _, x in SIDES])
    return out.select("*", "_c.*", *[F.size(f"_c.{x}_lem").cast("bigint").alias(f"{x}_n_types") for _, x in SIDES]).drop("_c")


def _typed(words: str, kinds: int) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("t"), F.lit(kinds).cast("bigint").alias("kinds")))


def _raised(twice: Column) -> Column:
    """True; an error where ``twice``: two rows with one key."""
    return F.when(twice, F.raise_error(F.lit("two rows share a key: " + ", ".join(PAIR))).cast("boolean")).isNull()


def _one_each(rows: DataFrame) -> DataFrame:
    """``rows``; two with one key are an error."""
    columns = [c for c in rows.columns if c not in PAIR]
    folded = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*columns)).alias("_row"))
    return folded.where(_raised(F.col("_n") > 1)).select(*PAIR, "_row.*")


def _rows(table: DataFrame) -> DataFrame:
    """(side, kind, t, kinds, v): a "doc" row per side and a "pair" row with their values, narrow rows per type and a "key" row."""
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in NUM) + ">")

    def row(side, kind, t=None, kinds=None, values=None):
        v = none if values is None else F.struct(*[values.get(c, F.lit(None)).cast("double").alias(c) for c in NUM])
        return F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if t is None else t).alias("t"),
                        (F.lit(None).cast("bigint") if kinds is None else kinds).alias("kinds"), v.alias("v"))

    docs = []
    for side, x in SIDES:
        ttr = F.try_divide(F.col(f"{x}_n_types").cast("double"), F.col(f"{x}_n_tokens").cast("double"))
        docs.append(row(side, "doc", values={"ttr": ttr, **{c: F.col(f"{x}_{c}") for c in ("n_tokens", "n_sents", "sum_token_len", "fre")}}))
    docs.append(row("target", "pair", values={c: F.col(c) for c in ("nov_1", "nov_2", "nov_3", "cmp")}))
    docs.append(row("target", "key", F.to_json(F.struct(*PAIR))))
    return table.select(F.inline(F.concat(F.array(*docs), F.transform("types", lambda x: row(None, "type", x["t"], x["kinds"])))))


def corpus_report(pairs: DataFrame, lemma_dict: DataFrame | None = None) -> DataFrame:
    """(ord, statistic, source, target) as doubles, in report order, in one pass.

    The aggregate that counts types also counts the rows of each key: pairs need no shuffle of their own.
    """
    rows = _rows(_pairs(pairs, lemma_dict, once=True))
    g1 = rows.groupBy("side", "kind", "t").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("kinds").alias("kinds"), *[F.sum(f"v.{c}").alias(f"s_{c}") for c in NUM],
        *[F.count(f"v.{c}").alias(f"c_{c}") for c in ("ttr", "fre", "cmp")])
    # a type counts on both sides
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.shiftright("kinds", 2 * i).alias("kinds")) for i, (side, _) in enumerate(SIDES)])
    g1 = g1.select("*", F.inline(F.when(F.col("kind") == "type", sides).otherwise(F.array(F.struct("side", "kinds")))).alias("of_side", "of_kinds"))
    kind = F.col("kind")

    def total(k, c):
        return F.sum(F.when(kind == k, F.col(c)))

    g2 = g1.groupBy(F.col("of_side").alias("side")).agg(
        total("doc", "n").alias("docs"),
        total("doc", "s_n_tokens").alias("tokens"), total("doc", "s_n_sents").alias("sentences"),
        total("doc", "s_sum_token_len").alias("sum_len"),
        total("doc", "s_ttr").alias("sum_ttr"), total("doc", "c_ttr").alias("n_ttr"),
        total("doc", "s_fre").alias("sum_fre"), total("doc", "c_fre").alias("n_fre"),
        *[F.count_if((kind == "type") & (F.col("of_kinds").bitwiseAND(k) != 0)).alias(c) for c, k in (("types_raw", K.RAW), ("types_lemmas", K.LEMMA))],
        total("pair", "n").alias("pairs"), *[total("pair", f"s_nov_{k}").alias(f"nov_{k}") for k in (1, 2, 3)],
        total("pair", "s_cmp").alias("sum_cmp"), total("pair", "c_cmp").alias("n_cmp"),
        F.max(F.when(kind == "key", F.col("n"))).alias("rows_of_key"),
    ).where(_raised(F.col("rows_of_key") > 1))

    def div(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    stats = g2.select(
        "side", "docs", "tokens", "sentences", "types_raw", "types_lemmas",
        div("tokens", "docs").alias("avg_words"), div("sentences", "docs").alias("avg_sents"),
        div("sum_ttr", "n_ttr").alias("avg_ttr"), div("sum_fre", "n_fre").alias("avg_fre"),
        div("sum_len", "tokens").alias("avg_word_len"), div("tokens", "sentences").alias("avg_sent_len"),
        *[(div(f"nov_{k}", "pairs") * 100).alias(f"nov_{k}") for k in (1, 2, 3)], div("sum_cmp", "n_cmp").alias("cmp"),
    )
    n = len(STAT_COLUMNS)
    entries = [(i, name, c) for i, (name, c) in enumerate(STAT_COLUMNS)]
    entries += [(n + k, f"Novelty (n={k + 1})", f"nov_{k + 1}") for k in range(3)] + [(n + 3, "CMP", "cmp")]
    long = stats.select("side", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("statistic"), F.col(c).cast("double").alias("value")) for i, name, c in entries])))
    side = F.col("side")
    return long.groupBy("ord", "statistic").agg(
        F.max(F.when((side == "source") & (F.col("ord") < n), F.col("value"))).alias("source"),
        F.max(F.when(side == "target", F.col("value"))).alias("target"),
    )


def corpus_novelty(pairs: DataFrame, lemma_dict: DataFrame | None = None) -> DataFrame:
    """Mean novelty n=1..3 in percent, and the line "a/b/c%"."""
    novelties = _pairs(pairs, lemma_dict).select(*PAIR, *[f"nov_{n}" for n in (1, 2, 3)])
    m = _one_each(novelties).agg(*[(F.avg(f"nov_{n}") * 100).alias(f"nov_{n}") for n in (1, 2, 3)])
    return m.select("*", _novelty_line(*[F.col(f"nov_{n}") for n in (1, 2, 3)]).alias("novelty"))


def _novelty_line(*values):
    return F.concat(F.concat_ws("/", *[T.round_exact(v, 0).cast("bigint").cast("string") for v in values]), F.lit("%"))


def format_report(report: DataFrame) -> DataFrame:
    """Display strings, rounded as Python formats them (thousands separator
    / 2 decimals), novelty as "n1/n2/n3%", CMP with 2 decimals, missing
    cells empty."""
    int_rows = [name for name, kind, _ in R.CORPUS_REPORT_ROWS if kind == "int"]
    n = len(STAT_COLUMNS)

    def two(c):
        return F.format_string("%.2f", T.round_exact(c, 2))

    def cell(c):
        whole = F.format_number(T.round_exact(c, 0), 0)
        return F.when(F.col(c).isNull(), "").when(F.col("statistic").isin(int_rows), whole).otherwise(two(c))

    stats = report.where(F.col("ord") < n).select("ord", "statistic", cell("source").alias("Source"), cell("target").alias("Target"))
    pick = lambda name: F.max(F.when(F.col("statistic") == name, F.col("target")))
    tail = report.agg(*[pick(f"Novelty (n={k})").alias(f"n{k}") for k in (1, 2, 3)], pick("CMP").alias("cmp"))
    tail = tail.select(F.inline(F.array(
        F.struct(F.lit(n).alias("ord"), F.lit("Novelty").alias("statistic"), F.lit("").alias("Source"), _novelty_line(F.col("n1"), F.col("n2"), F.col("n3")).alias("Target")),
        F.struct(F.lit(n + 1).alias("ord"), F.lit("CMP").alias("statistic"), F.lit("").alias("Source"), two("cmp").alias("Target")),
    )))
    return stats.unionByName(tail)
