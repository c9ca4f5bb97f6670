"""ROUGE-Lsum (summary-level LCS).

The reference text and the system text are split into sentences (T8, then on
newlines), each tokenised like ROUGE-1.  For every reference sentence the
LCS against each candidate sentence is found, the reference positions on
those LCS paths are united, and the united tokens are clipped by the
candidate's token counts:

    hits = sum_t min(union_t, count_sys_t)     (union_t <= count_ref_t)
    P = hits / |sys tokens|, R = hits / |ref tokens|, F = 2PR / (P + R)

The backtrack follows the usual order: match when tokens are equal, else
step left when the left cell is strictly larger, else up.  It decides which
positions enter the union, so it is kept exactly.

One row per reference sentence: an Arrow kernel returns the united tokens,
counting and clipping are an aggregate by (pair, system, token).  The kernel is bit-parallel:
a row of the LCS table is one integer whose bit j is 0 where the row grows at
candidate token j, and the next row takes four integer operations.  The rows are stored and the
backtrack reads table cells from them (a cell is the number of zeros below its
column).  Only rows whose token stands in the candidate are made: the others repeat the row before and
the backtrack passes them upwards.  Beyond MAX_CELLS bits only every B-th row is kept and
the rows between two kept ones are made again when the backtrack reaches them.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .evaluation import PAIR, Eval

MAX_CELLS = 4_000_000


def _rows(row: int, tokens: list[int], masks: dict[int, int], full: int) -> list[int]:
    """The row given and those after each of ``tokens``."""
    out = [row]
    for t in tokens:
        u = row & masks[t]
        row = ((row + u) | (row - u)) & full
        out.append(row)
    return out


def _mark(ref: list[int], can: tuple[int, ...], hit: np.ndarray) -> None:
    """Marks the reference positions on the LCS path with one candidate sentence."""
    masks: dict[int, int] = {}
    for j, t in enumerate(can):
        masks[t] = masks.get(t, 0) | 1 << j
    at = [p for p, t in enumerate(ref) if t in masks]
    if not at:
        return
    toks, n, full = [ref[p] for p in at], len(can), (1 << len(can)) - 1
    m = len(toks)
    block = m if m * n <= MAX_CELLS else max(1, math.isqrt(m))
    kept = [full]  # rows 0, block, 2 * block, ...
    for low in range(0, m - block, block):
        kept.append(_rows(kept[-1], toks[low:low + block], masks, full)[-1])
    i, j, cell = m, n, -1
    for low in range((m - 1) // block * block, -1, -block):  # rows low .. low + block
        rows = _rows(kept[low // block], toks[low:low + block], masks, full)
        if cell < 0:
            cell = n - rows[-1].bit_count()
        while i > low and cell:
            if toks[i - 1] == can[j - 1]:
                hit[at[i - 1]] = True
                i, j, cell = i - 1, j - 1, cell - 1
                continue
            up = j - (rows[i - 1 - low] & ((1 << j) - 1)).bit_count()
            left = cell - (~rows[i - low] >> (j - 1) & 1)
            if left > up:
                j, cell = j - 1, left
            else:
                i, cell = i - 1, up
        if not cell:
            return


def _chunk_hits(ref: list[int], can: list[int], starts: list[int], lens: list[int]) -> np.ndarray:
    """Booleans: reference position on the LCS path with any candidate sentence of the chunk (equal ones count once)."""
    hit = np.zeros(len(ref), dtype=bool)
    for c in {tuple(can[a:a + n]) for a, n in zip(starts, lens)}:
        _mark(ref, c, hit)
    return hit


def chunks(lens: list[int], rows: int) -> list[tuple[int, int]]:
    """Consecutive candidate ranges with rows * tokens <= MAX_CELLS (at least one sentence each)."""
    out, k = [], 0
    while k < len(lens):
        e, total = k + 1, lens[k]
        while e < len(lens) and (total + lens[e]) * rows <= MAX_CELLS:
            total += lens[e]
            e += 1
        out.append((k, e))
        k = e
    return out


def union_tokens(ref: list[str], cans: list[list[str]]) -> list[str]:
    """The tokens of one reference sentence on its LCS path with any candidate sentence."""
    vocab = {t: k for k, t in enumerate({t for c in cans for t in c})}
    kept = [t for t in ref if t in vocab]  # tokens of no candidate are on no path and do not change one
    if not kept:
        return []
    codes = [vocab[t] for t in kept]
    cans_c = [[vocab[t] for t in c] for c in cans if len(c)]
    lens = [len(c) for c in cans_c]
    hit = np.zeros(len(codes), dtype=bool)
    for a, b in chunks(lens, 2 * math.isqrt(len(codes)) + 2):
        starts = [0, *accumulate(lens[a:b - 1])]
        hit |= _chunk_hits(codes, [t for c in cans_c[a:b] for t in c], starts, lens[a:b])
    return [t for t, h in zip(kept, hit) if h]


@pandas_udf(Ty.ArrayType(Ty.StringType()))
def _union(ref: pd.Series, cans: pd.Series) -> pd.Series:
    return pd.Series([union_tokens(list(r), [list(c) for c in cs]) for r, cs in zip(ref, cans)], dtype=object)


def lsum_sentences(col) -> Column:
    """Sentence token lists for ROUGE-Lsum: T8 sentences, split on newlines,
    empty pieces dropped, ROUGE tokens per piece."""
    sents = T.sentence_array(T.plain_marked_sentences(col))
    pieces = F.filter(F.flatten(F.transform(sents, lambda s: F.split(s, "\n"))), lambda s: F.length(s) > 0)
    return F.transform(pieces, lambda s: T.rouge_tokens(s))


def rouge_lsum(ev: Eval) -> DataFrame:
    """(system, precision, recall, fmeasure): means over pairs x100.  ``ev`` should be clustered by pair."""
    names = ["ref", *[f"y{i}" for i in range(len(ev.systems))]]
    sents = ev.rows.select(*PAIR, *[lsum_sentences(c).alias(c) for c in names])
    per = sents.select(*PAIR, F.col("ref").alias("refs"), F.inline(ev.per_system(lambda i: [F.col(f"y{i}").alias("cans")])))
    # a row per reference sentence (pos -1: no sentence); the candidate's tokens are counted at the first
    rows = per.select(*PAIR, "system", "cans", F.posexplode_outer("refs").alias("pos", "ref"))
    united = rows.select(*PAIR, "system", F.coalesce("pos", F.lit(0)).alias("pos"), "cans", F.coalesce("ref", F.array().cast("array<string>")).alias("ref"))
    united = united.select(*PAIR, "system", "pos", F.when(F.col("pos") == 0, F.flatten("cans")).alias("can"), "ref", _union("ref", "cans").alias("union"))
    tagged = F.concat(
        F.transform(F.coalesce("can", F.array().cast("array<string>")), lambda t: F.struct(F.lit("c").alias("side"), t.alias("t"))),
        F.transform("ref", lambda t: F.struct(F.lit("r").alias("side"), t.alias("t"))),
        F.transform("union", lambda t: F.struct(F.lit("u").alias("side"), t.alias("t"))),
    )
    tokens = united.select(*PAIR, "system", F.explode_outer(tagged).alias("x")).select(*PAIR, "system", "x.side", "x.t")
    counts = tokens.groupBy(*PAIR, "system", "t").agg(*[F.count_if(F.col("side") == s).alias(s) for s in "cru"])
    pairs = counts.groupBy(*PAIR, "system").agg(F.sum(F.least("u", "c")).alias("hits"), F.sum("r").alias("m"), F.sum("c").alias("n"))
    p = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0))
    r = F.when(F.col("m") > 0, F.col("hits") / F.col("m")).otherwise(F.lit(0.0))
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    scored = pairs.select("system", p.alias("p"), r.alias("r")).withColumn("f", f)
    return scored.groupBy("system").agg((F.avg("p") * 100).alias("precision"), (F.avg("r") * 100).alias("recall"), (F.avg("f") * 100).alias("fmeasure"))
