"""Evaluation of system outputs against references.

Input: an :class:`Eval`, one row per pair (split, pair_id, orig, ref) with one
column per system (y0, y1, ...).  What belongs to the pair (tokens and n-grams
of orig and ref) is therefore computed once, however many systems there are.

One n-gram count table (J3) serves ROUGE-1/2, BLEU and SARI: the texts of a pair are
brought together, an Arrow kernel counts their n-grams and gives one row per (kind, n, gram) with the
counts of orig, ref and every system.  The rows are clustered by (split, pair_id)
first, so grouping the texts and the aggregate per pair after it run
without an exchange; only the tiny per-system results are shuffled.  No table of n-grams is hashed
or sorted: memory follows the texts of one pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import cluster
from . import stats as A

PAIR = ("split", "pair_id")
ORIG, REF, FIRST_SYS = 0, 1, 2
KINDS = ("rouge", "bleu", "sari")
ROUGE_ORDERS = (1, 2)
BLEU_ORDERS = (1, 2, 3, 4)
SARI_PARTS = ("add_sys", "add_ref", "add_ok", "keep_sys", "keep_ref", "keep_ok", "del_sys", "del_ref", "del_ok")
PAIR_STATS = ("hits", "sys_total", "ref_total", *SARI_PARTS)


class Eval(NamedTuple):
    """rows(split, pair_id, orig, ref, y0, y1, ...) and the names of the systems behind the y columns."""

    rows: DataFrame
    systems: tuple[str, ...]

    def clustered(self) -> Eval:
        """Hash-partitioned by pair: one shuffle of the texts instead of one of the much larger n-gram rows."""
        return Eval(cluster(self.rows, *PAIR), self.systems)

    def long(self) -> DataFrame:
        """(system, split, pair_id, orig, ref, sys)."""
        return self.rows.select(*PAIR, "orig", "ref", F.inline(F.array(*[
            F.struct(F.lit(name).alias("system"), F.col(f"y{i}").alias("sys")) for i, name in enumerate(self.systems)
        ]))).select("system", *PAIR, "orig", "ref", "sys")

    def per_system(self, make) -> F.Column:
        """An array with one struct (system, *make(i)) per system."""
        return F.array(*[F.struct(F.lit(name).alias("system"), *make(i)) for i, name in enumerate(self.systems)])


def _orders(kind: str) -> tuple[int, ...]:
    return ROUGE_ORDERS if kind == "rouge" else BLEU_ORDERS


TOGETHER = 64  # pairs whose counts a worker holds at once


_RULES_13A = [(re.compile(pattern), repl) for pattern, repl in R.TOKEN_13A_RULES]


def _tokens_13a(text: str) -> list[str]:
    """As :func:`textlab.functions.text.tokens_13a`, of a text already lower-cased if wanted."""
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in R.HTML_ENTITIES if "&" in t else ():
        t = t.replace(a, b)
    t = f" {t} "
    for pattern, repl in _RULES_13A:
        t = pattern.sub(repl, t)
    return t.split()


_TOKENS = {"rouge": re.compile(R.ROUGE_TOKEN).findall, "bleu": _tokens_13a, "sari": _tokens_13a}


def _count(kind: str, texts: list[str | None], order: Sequence[int]) -> list[Counter]:
    """The n-grams of one side of a pair (usually one text), a counter per order."""
    out = [Counter() for _ in order]
    for text in texts:
        toks = _TOKENS[kind](text or "")
        for n, counter in zip(order, out):
            counter.update(toks if n == 1 else map(R.GRAM_SEP.join, zip(*[toks[k:] for k in range(n)])))
    return out


def _counter(specs: Sequence[tuple[str, int]], order: dict[str, tuple[int, ...]], sides: int):
    """The kernel: per pair, from the texts of its rows, the structs (kind, n, gram, c0, c1, ...), a count per side."""
    names = [f"c{k}" for k in range(sides)]
    kinds = {kind: [(side, i) for i, (k, side) in enumerate(specs) if k == kind] for kind in order}

    def counted(pairs: list[list[list[str | None]]]) -> pa.Array:
        kind_of, n_of, grams, counts, ends = [], [], [], [[] for _ in range(sides)], [0]
        for columns in pairs:
            for kind, fields in kinds.items():
                known: dict = {}  # equal texts are counted once
                for side, i in fields:
                    if (key := tuple(columns[i])) not in known:
                        known[key] = _count(kind, columns[i], order[kind])
                for k, n in enumerate(order[kind]):
                    by_side = {side: known[tuple(columns[i])][k] for side, i in fields}
                    found = list(dict.fromkeys(g for c in {id(c): c for c in by_side.values()}.values() for g in c))
                    size = len(found) + 1  # and the row without a gram
                    kind_of += [kind] * size
                    n_of += [n] * size
                    grams += found
                    grams.append(None)
                    for side, out in enumerate(counts):
                        if side in by_side:
                            out += map(by_side[side].get, found, repeat(0))
                            out.append(0)
                        else:
                            out += [0] * size
            ends.append(len(grams))
        fields = [pa.array(kind_of, pa.string()), pa.array(n_of, pa.int32()), pa.array(grams, pa.string()), *[pa.array(c, pa.int64()) for c in counts]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "n", "gram", *names]))

    @F.arrow_udf("array<struct<kind string, n int, gram string, " + ", ".join(f"{c} bigint" for c in names) + ">>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for low in range(0, len(batch), TOGETHER):
                part = batch.slice(low, TOGETHER)
                rows, ends = part.flatten(), [0, *pa.compute.cumulative_sum(part.value_lengths()).to_pylist()]
                columns = [rows.field(i).to_pylist() for i in range(len(specs))]
                yield counted([[c[a:b] for c in columns] for a, b in zip(ends, ends[1:])])

    return count


def ngram_counts(ev: Eval, kinds: Sequence[str] = KINDS, orders: Sequence[int] | None = None) -> DataFrame:
    """(split, pair_id, kind, n, gram, c_orig, c_ref, c0, c1, ...).

    Every (pair, kind, n) also has one row with a NULL gram and zero counts,
    so pairs without n-grams still take part in the means.  ``ev`` should be
    clustered by pair; rows that share a pair are counted together.
    """
    texts = ["orig", "ref", *[f"y{i}" for i in range(len(ev.systems))]]
    specs = [(kind, side) for kind in kinds for side in range(len(texts)) if not (side == ORIG and kind != "sari")]
    cased = lambda kind, c: F.col(c) if kind == "bleu" else F.lower(c)
    rows = ev.rows.select(*PAIR, F.struct(*[cased(kind, texts[side]).alias(f"{kind}_{side}") for kind, side in specs]).alias("texts"))
    count = _counter(specs, {kind: tuple(orders or _orders(kind)) for kind in kinds}, len(texts))
    grams = rows.groupBy(*PAIR).agg(F.collect_list("texts").alias("texts")).select(*PAIR, count("texts").alias("grams"))
    named = {"c0": "c_orig", "c1": "c_ref", **{f"c{FIRST_SYS + i}": f"c{i}" for i in range(len(ev.systems))}}
    flat = grams.select(*PAIR, F.inline_outer("grams"))  # never empty; a plain inline would run the kernel twice, for a filter on the size
    return flat.select(*PAIR, "kind", "n", "gram", *[F.col(c).alias(name) for c, name in named.items()])


def pair_order_stats(counts: DataFrame, ev: Eval) -> DataFrame:
    """(system, split, pair_id, kind, n): clipped hits, totals and SARI parts."""
    o, r = F.col("c_orig"), F.col("c_ref")
    aggs = []
    for i in range(len(ev.systems)):
        s = F.col(f"c{i}")
        d_s, d_r = F.greatest(o - s, F.lit(0)), F.greatest(o - r, F.lit(0))
        parts = {
            "hits": F.sum(F.least(s, r)), "sys_total": F.sum(s), "ref_total": F.sum(r),
            "add_sys": F.count_if((s > 0) & (o == 0)), "add_ref": F.count_if((r > 0) & (o == 0)),
            "add_ok": F.count_if((s > 0) & (r > 0) & (o == 0)),
            "keep_sys": F.sum(F.least(o, s)), "keep_ref": F.sum(F.least(o, r)), "keep_ok": F.sum(F.least(o, s, r)),
            "del_sys": F.sum(d_s), "del_ref": F.sum(d_r), "del_ok": F.sum(F.least(d_s, d_r)),
        }
        aggs += [parts[c].alias(f"{c}_{i}") for c in PAIR_STATS]
    wide = counts.groupBy(*PAIR, "kind", "n").agg(*aggs)
    rows = wide.select(*PAIR, "kind", "n", F.inline(ev.per_system(lambda i: [F.col(f"{c}_{i}").alias(c) for c in PAIR_STATS])))
    return rows.select("system", *PAIR, "kind", "n", *PAIR_STATS)


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _safe_div(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _mean(cols):
    return reduce(lambda a, x: a + x, cols) / len(cols)


def ngram_metrics(stats: DataFrame) -> DataFrame:
    """ROUGE-1/2 (P, R, F), BLEU and SARI for every system from ONE
    aggregation of the per-(pair, kind, n) statistics.

    Columns: system, r{n}_p, r{n}_r, r{n}_f (means over pairs x100), bleu
    (pooled counts, exp smoothing, brevity penalty), sari_add, sari_keep,
    sari_del, sari (pooled counts).  Metrics of kinds that are not in
    ``stats`` are NULL or zero: select what was counted.
    """
    kind, n = F.col("kind"), F.col("n")
    aggs = []
    for k in ROUGE_ORDERS:
        on = (kind == "rouge") & (n == k)
        p = F.col("hits") / F.greatest(F.col("sys_total"), F.lit(1))
        r = F.col("hits") / F.greatest(F.col("ref_total"), F.lit(1))
        aggs += [F.avg(F.when(on, x) * 100).alias(f"r{k}_{c}") for c, x in (("p", p), ("r", r), ("f", _f1(p, r)))]
    for k in BLEU_ORDERS:
        on = (kind == "bleu") & (n == k)
        aggs += [F.sum(F.when(on, F.col("hits"))).alias(f"c{k}"), F.sum(F.when(on, F.col("sys_total"))).alias(f"t{k}")]
        aggs += [F.sum(F.when((kind == "sari") & (n == k), F.col(c))).alias(f"{c}{k}") for c in SARI_PARTS]
    aggs.append(F.sum(F.when((kind == "bleu") & (n == 1), F.col("ref_total"))).alias("ref_len"))
    g = stats.groupBy("system").agg(*aggs)

    logs, zero_orders = [], F.lit(0)
    for k in BLEU_ORDERS:
        c, t = F.col(f"c{k}"), F.col(f"t{k}")
        zero_orders = zero_orders + F.when((t > 0) & (c == 0), 1).otherwise(0)
        p = F.when(t == 0, F.lit(0.0)).when(c > 0, 100.0 * c / t).otherwise(100.0 / (F.pow(F.lit(2.0), zero_orders) * t))
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)))
    sys_len, ref_len = F.col("t1"), F.col("ref_len")
    penalty = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))

    def op_mean(op):
        return 100 * _mean([_f1(_safe_div(F.col(f"{op}_ok{k}"), F.col(f"{op}_sys{k}")),
                                _safe_div(F.col(f"{op}_ok{k}"), F.col(f"{op}_ref{k}"))) for k in BLEU_ORDERS])

    out = g.select(
        "system", *[f"r{k}_{x}" for k in ROUGE_ORDERS for x in ("p", "r", "f")],
        (penalty * F.exp(_mean(logs))).alias("bleu"),
        op_mean("add").alias("sari_add"), op_mean("keep").alias("sari_keep"), op_mean("del").alias("sari_del"),
    )
    return out.withColumn("sari", _mean([F.col("sari_add"), F.col("sari_keep"), F.col("sari_del")]))


def rouge_n(ev: Eval, n: int) -> DataFrame:
    """(system, precision, recall, fmeasure); only ROUGE n-grams of order n are counted."""
    m = ngram_metrics(pair_order_stats(ngram_counts(ev, ("rouge",), (n,)), ev))
    return m.select("system", F.col(f"r{n}_p").alias("precision"), F.col(f"r{n}_r").alias("recall"), F.col(f"r{n}_f").alias("fmeasure"))


def bleu(ev: Eval) -> DataFrame:
    """(system, bleu)."""
    return ngram_metrics(pair_order_stats(ngram_counts(ev, ("bleu",)), ev)).select("system", "bleu")


def sari(ev: Eval) -> DataFrame:
    """(system, sari_add, sari_keep, sari_del, sari)."""
    m = ngram_metrics(pair_order_stats(ngram_counts(ev, ("sari",)), ev))
    return m.select("system", "sari_add", "sari_keep", "sari_del", "sari")


def surface_stats(ev: Eval) -> DataFrame:
    """Per system means of |x|_w, |x|_s, |y|_w, |y|_s, CMP_w, CMP_s and
    surface-token novelty n=1,2 (x100).  Each text is split and cleaned once."""
    names = ["orig", *[f"y{i}" for i in range(len(ev.systems))]]
    marked = ev.rows.select(*[T.plain_marked_sentences(c).alias(c) for c in names])
    sized = marked.select(*[F.size(T.sentence_array(c)).alias(f"s_{c}") for c in names], *[T.token_array(c).alias(f"t_{c}") for c in names])
    clean = sized.select(*[f"s_{c}" for c in names], *[F.size(f"t_{c}").alias(f"w_{c}") for c in names],
                         *[T.clean_tokens(f"t_{c}").alias(f"c_{c}") for c in names])
    per = clean.select(F.inline(ev.per_system(lambda i: [
        F.col("w_orig").alias("xw"), F.col("s_orig").alias("xs"), F.col(f"w_y{i}").alias("yw"), F.col(f"s_y{i}").alias("ys"),
        T.ratio(f"w_y{i}", "w_orig").alias("cmp_w"), T.ratio(f"s_y{i}", "s_orig").alias("cmp_s"),
        (T.novelty("c_orig", f"c_y{i}", 1, clean=False) * 100).alias("nov_1"),
        (T.novelty("c_orig", f"c_y{i}", 2, clean=False) * 100).alias("nov_2"),
    ])))
    return per.groupBy("system").agg(
        F.avg("xw").alias("x_w"), F.avg("xs").alias("x_s"), F.avg("yw").alias("y_w"), F.avg("ys").alias("y_s"),
        F.avg("cmp_w").alias("cmp_w"), F.avg("cmp_s").alias("cmp_s"),
        F.avg("nov_1").alias("nov_1"), F.avg("nov_2").alias("nov_2"),
    )


def _long(df: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in mapping])
    return df.select("system", F.inline(arr))


def metric_table(ev: Eval, with_lsum: bool = False, surface: bool = True) -> DataFrame:
    """Long (system, metric, value) for all systems in one job.

    The rows are clustered by pair once; the n-gram, surface and LCS
    branches all start from that partitioning.
    """
    ev = ev.clustered()
    gram = ngram_metrics(pair_order_stats(ngram_counts(ev), ev))
    mapping = []
    for k in ROUGE_ORDERS:
        mapping += [(f"R-{k}", f"r{k}_f"), (f"R-{k}_p", f"r{k}_p"), (f"R-{k}_r", f"r{k}_r")]
    mapping += [("BLEU", "bleu"), ("SARI", "sari")]
    parts = [_long(gram, mapping)]
    if surface:
        parts.append(_long(surface_stats(ev), [
            ("|x|_w", "x_w"), ("|x|_s", "x_s"), ("|y|_w", "y_w"), ("|y|_s", "y_s"),
            ("CMP_w", "cmp_w"), ("CMP_s", "cmp_s"), ("Nov. (n=1)", "nov_1"), ("Nov. (n=2)", "nov_2"),
        ]))
    if with_lsum:
        from .lcs import rouge_lsum
        parts.append(_long(rouge_lsum(ev), [("R-L", "fmeasure"), ("R-L_p", "precision"), ("R-L_r", "recall")]))
    return reduce(DataFrame.unionByName, parts)


def metric_report(metrics: DataFrame, names: list[str], precision: int | None = None) -> DataFrame:
    """Systems as rows, the chosen metrics as columns in order;
    with ``precision`` rounded as Python formats them."""
    unknown = [m for m in names if m not in R.ALL_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    value = F.col("value") if precision is None else T.round_exact("value", precision)
    sel = metrics.where(F.col("metric").isin(names))
    return sel.groupBy("system").pivot("metric", names).agg(F.first(value))
