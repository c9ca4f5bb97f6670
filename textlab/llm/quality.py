"""Quality classifier: a sparse ensemble of rules compiled into columns.

1. Statistics of a text are Spark column expressions (``statistics``).
2. Small boosted trees are grown on the statistics of a bounded sample of
   labelled rows (``SAMPLE_ROWS``, the only bound; the rows with the smallest
   id hash).  Every path from a root to a node is a rule: a conjunction of
   ``statistic <= t`` and ``statistic > t``.
3. A lasso logistic regression on the 0/1 rules keeps few of them.
4. The kept rules and weights are compiled into one column expression, so all
   documents are scored inside the scan without a shuffle and without Python.

Labels, language, source and id are never inputs of a score.

Edge cases: null texts are scored as empty ones; an empty text has defined
statistics (ratios 0) and a score; repeated labels of an id are averaged (1 if
at least half say 1), null labels are left out; without usable labels, or with
one class only, the score is the smoothed share of label 1; an empty table
gives no rows; extra columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold

SAMPLE_ROWS = 12_000   # labelled rows the trees and weights are fitted on
HELD_OUT_FOLDS, HELD_OUT = 4, 2
TREES, DEPTH, BINS, LEAST_LEAF = 24, 3, 32, 20
LEARNING_RATE = 0.3
PENALTY = 0.002        # lasso weight, per row
THRESHOLD = 0.7

_SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: F.Column, prefix: str = "q_") -> dict[str, list[F.Column]]:
    """Two layers of columns: counts from the text, then ratios from the counts (by name)."""
    c = lambda name: F.col(prefix + name)
    words, lines = F.split(F.btrim(text), _SPACE), F.split(text, "\n")
    counts = {
        "chars": F.length(text),
        "words": F.size(words),
        "distinct_words": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")),
        "stops": F.regexp_count(text, F.lit(r"[.,]")),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")),
        "bars": F.regexp_count(text, F.lit(r"\|")),
    }
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    ratios = {
        "n_chars": c("chars").cast("double"),
        "word_length": per("chars", "words"),
        "distinct_word_share": per("distinct_words", "words"),
        "distinct_line_share": per("distinct_lines", "lines"),
        "line_length": per("chars", "lines"),
        "upper_share": per("upper", "chars"),
        "symbol_share": per("symbols", "words"),
        "stop_share": per("stops", "words"),
        "digit_share": per("digits", "chars"),
        "bar_share": per("bars", "words"),
    }
    return {
        "counts": [x.alias(prefix + k) for k, x in counts.items()],
        "ratios": [x.alias(prefix + "r_" + k) for k, x in ratios.items()],
        "names": [prefix + "r_" + k for k in ratios],
    }


# ------------------------------------------------------------------ fitting


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, leaf: list) -> None:
    """One regression tree on binned statistics; appends each node's path to ``out``."""
    if path:
        out.append(path)
    best = (1e-6, 0, 0)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        g, h, b = grad[rows], hess[rows], binned[rows]
        total = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(b.shape[1]):
            n = np.cumsum(np.bincount(b[:, j], minlength=BINS))[:-1]
            gl, hl = (np.cumsum(np.bincount(b[:, j], weights=w, minlength=BINS))[:-1] for w in (g, h))
            gain = gl ** 2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[0] <= 1e-6:
        leaf.append((rows, -grad[rows].sum() / (hess[rows].sum() + 1.0)))
        return
    _, j, k = best
    low = binned[rows, j] <= k
    _grow(binned, grad, hess, rows[low], depth - 1, (*path, (j, "<=", k)), out, leaf)
    _grow(binned, grad, hess, rows[~low], depth - 1, (*path, (j, ">", k)), out, leaf)


def _bins(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    return np.stack([np.searchsorted(q, col, side="left") for q, col in zip(cuts, x.T)], axis=1), cuts


def _active(binned: np.ndarray, path: tuple) -> np.ndarray:
    on = np.ones(len(binned), bool)
    for j, op, k in path:
        on &= binned[:, j] <= k if op == "<=" else binned[:, j] > k
    return on


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, p = a.shape
    mean = a.mean(axis=0)
    x = a - mean
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1e-9)
    b0 = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w, z, t = np.zeros(p), np.zeros(p), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(x @ z + b0))) - y
        b0 -= 2.0 * r.mean()
        new = z - step * (x.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return b0 - float(mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees, their paths as rules, lasso weights: {intercept, rules: [(weight, [(statistic, op, t)])]}."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) == 0 or y.min() == y.max():
        return {"intercept": float(np.log(share / (1 - share))), "rules": []}
    binned, cuts = _bins(x)
    f, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        leaf: list = []
        _grow(binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), paths, leaf)
        for rows, value in leaf:
            f[rows] += LEARNING_RATE * value
    columns, kept, seen = [], [], set()
    for path in paths:
        on = _active(binned, path)
        if on.tobytes() not in seen and not on.all() and on.any():
            seen.add(on.tobytes())
            columns.append(on)
            kept.append(path)
    if not kept:
        return {"intercept": float(np.log(share / (1 - share))), "rules": []}
    b0, w = lasso_logistic(np.stack(columns, axis=1).astype(float), y.astype(float), PENALTY)
    rules = [(float(v), [(j, op, float(cuts[j][k])) for j, op, k in path]) for v, path in zip(w, kept) if abs(v) > 1e-4]
    return {"intercept": b0, "rules": rules}


def compile_score(model: dict, names: list[str]) -> F.Column:
    """The rule ensemble as one column expression."""
    z = F.lit(model["intercept"])
    for weight, tests in model["rules"]:
        on = F.lit(True)
        for j, op, t in tests:
            on = on & (F.col(names[j]) <= t if op == "<=" else F.col(names[j]) > t)
        z = z + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# ------------------------------------------------------------------ operator


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on at most SAMPLE_ROWS labelled rows outside the held-out fold."""
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(id_fold(id_col, HELD_OUT_FOLDS) != HELD_OUT)
    lab = lab.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("q_label"))
    lab = lab.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS)  # the documented bound of the sample
    s = statistics(F.col("q_text"))
    x = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("q_text")).join(F.broadcast(lab), id_col)
    x = x.select("q_label", *s["counts"]).select("q_label", *s["ratios"])
    pdf = x.toPandas()
    pdf = pdf.sort_values(list(pdf.columns), kind="stable")
    return fit_rules(pdf[s["names"]].to_numpy(float), pdf["q_label"].to_numpy(int))


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted (existing columns of these names are replaced)."""
    s = statistics(F.col("q_text"))
    kept = [F.col(k).alias(f"q_keep_{i}") for i, k in enumerate(keep)]
    back = [F.col(f"q_keep_{i}").alias(k) for i, k in enumerate(keep)]
    hold = [f"q_keep_{i}" for i in range(len(keep))]
    x = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    x = x.select(*hold, *s["counts"]).select(*hold, *s["ratios"]).select(*hold, compile_score(model, s["names"]).alias("q_score"))
    return x.select(*back, F.col("q_score").alias("score"), (F.col("q_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules do not reject, with the same columns.

    A plain filter would be pushed below the statistics, with a copy of them for every
    rule that names them.  So the row is put into an array of one or none and taken out again.
    """
    s, names = statistics(F.col("q_text")), docs.columns
    hold = [f"q_keep_{i}" for i in range(len(names))]
    x = docs.select(*[F.col(k).alias(h) for k, h in zip(names, hold)], F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    x = x.select(*hold, *s["counts"]).select(*hold, *s["ratios"]).select(*hold, compile_score(model, s["names"]).alias("q_score"))
    row = F.struct(F.lit(True).alias("q_good"), *hold)
    x = x.select(F.inline_outer(F.when(F.col("q_score") >= THRESHOLD, F.array(row)))).filter("q_good IS NOT NULL")
    return x.select(*[F.col(h).alias(k) for k, h in zip(names, hold)])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    x = score(docs, fit(docs, labels, id_col, text_col), [id_col], text_col)
    return x.select(F.col(id_col).alias("doc_id"), (id_fold(id_col, HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
