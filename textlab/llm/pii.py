"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns and checks (``base_spans``).  The field
then labels the white-space-separated tokens of the document (none, email, ip, card, phone):

* unary potentials: a softmax over token shapes, fitted on the tokens of a
  bounded sample of documents with the base spans as labels (``SAMPLE_ROWS``,
  ``SAMPLE_CHARS``);
* chain potentials between neighbours, from smoothed label-pair counts;
* skip potentials between each two successive tokens of a document with the
  same key (digits, or the local part of an address), so that distant
  repeated or similar tokens agree.  Linking successive occurrences keeps the
  number of skip links linear.

Inference is loopy sum-product with ``ROUNDS`` flooding rounds.  In so many rounds
nothing travels further than ``ROUNDS`` links, so a token with neither digit nor @
that is further away from all others that have one has the belief of
an empty context (label none); such tokens are left out of the graph without
changing any other belief's evidence.  A text without digit and @ needs no graph.

Tokens with a digit or an @ whose belief in one kind reaches ``SURE`` and
which touch no base span become added spans; neighbours of one kind are joined.

Edge cases: null and empty texts have no spans; very long texts are one row
with vectorised messages; without any base span in the sample nothing is
added; repeated rows get equal results; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2_000      # documents with digits or @ the potentials are fitted on,
SAMPLE_CHARS = 20_000    # none of them longer than this
ROUNDS = 6
SURE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # from each @, so that long runs without one cost nothing
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGITS.search(text):
        return out
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                    out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ------------------------------------------------------------------ the field

FEATURES = 20


def shape(token: str) -> list[float]:
    core = token.strip(".,;:!?()[]\"'")
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    groups = re.split(r"[^0-9]+", core)
    at = core.find("@")
    return [
        1.0, at > 0, at > 0 and "." in core[at:], "@" in core, core.startswith("+"), "(" in token or ")" in token,
        digits == 0, 0 < digits <= 2, 2 < digits <= 4, 4 < digits <= 7, 7 < digits < 13, 13 <= digits <= 15, 16 <= digits <= 19, digits > 19,
        letters > 0, letters > digits, core.count(".") == 3 and letters == 0, "-" in core, 16 <= digits <= 19 and luhn(re.sub("[^0-9]", "", core)),
        sum(bool(g) for g in groups) == 4 and all(len(g) <= 3 for g in groups) and letters == 0,
    ]


def key_of(token: str) -> str:
    at = token.find("@")
    if at > 0:
        return token[:at].lower().lstrip("(\"'<")
    digits = re.sub("[^0-9]", "", token)
    if sum(c.isalpha() for c in token):
        return token.strip(".,;:!?()[]\"'").lower()
    return digits if len(digits) >= 4 else ""


class Graph:
    """The tokens of one batch of texts that matter, with chain and skip links."""

    def __init__(self, texts: list[str]):
        self.doc, self.start, self.end, self.token, self.hard = [], [], [], [], []
        chain, skip = [], []
        for d, text in enumerate(texts):
            if not _EVIDENCE.search(text):
                continue
            tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
            hard = [i for i, (a, b) in enumerate(tokens) if _EVIDENCE.search(text, a, b)]
            near = sorted({j for i in hard for j in range(max(0, i - ROUNDS), min(len(tokens), i + ROUNDS + 1))})
            base, last, hot = len(self.doc), {}, set(hard)
            for n, j in enumerate(near):
                a, b = tokens[j]
                self.doc.append(d)
                self.start.append(a)
                self.end.append(b)
                self.token.append(text[a:b] if j in hot else "")
                self.hard.append(j in hot)
                if n and near[n - 1] == j - 1:
                    chain.append((base + n - 1, base + n))
                if j in hot and (key := key_of(text[a:b])):
                    if key in last:
                        skip.append((last[key], base + n))
                    last[key] = base + n
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.x = np.array([shape(t) if h else _PLAIN for t, h in zip(self.token, self.hard)], float).reshape(-1, FEATURES)

    def labels(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """Label 1 + kind where a base span overlaps the token (the first kind wins), else 0."""
        out = np.zeros(len(self.doc), np.int64)
        for i, d in enumerate(self.doc):
            if self.hard[i]:
                out[i] = next((k + 1 for k, a, b in spans[d] if a < self.end[i] and b > self.start[i]), 0)
        return out

    def beliefs(self, model: dict) -> np.ndarray:
        """Loopy sum-product in the log domain, all messages of a round at once."""
        unary = self.x @ model["unary"]
        unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
        src = np.concatenate([self.chain[:, 0], self.chain[:, 1], self.skip[:, 0], self.skip[:, 1]])
        dst = np.concatenate([self.chain[:, 1], self.chain[:, 0], self.skip[:, 1], self.skip[:, 0]])
        c, s = len(self.chain), len(self.skip)
        if not len(src):
            return np.exp(unary)
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)]).astype(np.int64)
        psi = np.concatenate([np.broadcast_to(model["chain"], (c, 5, 5)), np.broadcast_to(model["chain"].T, (c, 5, 5)), np.broadcast_to(model["skip"], (2 * s, 5, 5))])
        msg = np.zeros((len(src), 5))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, dst, msg)
            out = np.logaddexp.reduce((total[src] - msg[back])[:, :, None] + psi, axis=1)
            msg = out - np.logaddexp.reduce(out, axis=1, keepdims=True)
        total = unary.copy()
        np.add.at(total, dst, msg)
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


_PLAIN = [1.0] + [0.0] * 5 + [1.0] + [0.0] * 7 + [1.0, 1.0] + [0.0] * 4


def fit(texts: list[str]) -> dict | None:
    """Piecewise training with the base spans as labels; None if there are none."""
    g = Graph(texts)
    y = g.labels([base_spans(t) for t in texts])
    if not y.any():
        return None
    w, onehot, n = np.zeros((FEATURES, 5)), np.eye(5)[y], len(y)
    step, velocity = 2.0, np.zeros((FEATURES, 5))
    for _ in range(400):  # ridge softmax regression, gradient with momentum
        z = g.x @ w
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        velocity = 0.9 * velocity - step * (g.x.T @ (p - onehot) / n + 1e-4 * w) * 0.3
        w = w + velocity

    def pairs(links: np.ndarray, symmetric: bool) -> np.ndarray:
        # before any count, similar tokens are taken to agree
        t = np.full((5, 5), 0.1) + 2.0 * np.eye(5) if symmetric else np.full((5, 5), 0.5)
        np.add.at(t, (y[links[:, 0]], y[links[:, 1]]), 1.0)
        t = t + t.T if symmetric else t
        t /= t.sum()
        ratio = np.log(t / (t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True)))
        return np.clip(ratio, -4.0, 4.0)

    return {"unary": w, "chain": pairs(g.chain, False), "skip": pairs(g.skip, True)}


def find(texts: list[str], model: dict | None) -> tuple[list[list], list[list]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) if _EVIDENCE.search(t) else [] for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is None:
        return base, added
    g = Graph(texts)
    if not len(g.doc):
        return base, added
    belief = g.beliefs(model)
    for i in np.flatnonzero((belief[:, 1:].max(axis=1) >= SURE) & np.array(g.hard)):
        d, k, text = g.doc[i], int(belief[i, 1:].argmax()), texts[g.doc[i]]
        a, b = g.start[i], g.end[i]
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b or any(s < b and e > a for _, s, e in base[d]):
            continue
        if added[d] and added[d][-1][0] == k and text[added[d][-1][2]:a].strip("() .-") == "" and a - added[d][-1][2] <= 3:
            added[d][-1] = (k, added[d][-1][1], b)
        else:
            added[d].append((k, a, b))
    return base, added


def train(docs: DataFrame, text_col: str = "text") -> dict | None:
    """Fit on the SAMPLE_ROWS texts with digits or @ that have the smallest hash."""
    t = docs.select(F.col(text_col).alias("t")).filter(F.col("t").rlike("[0-9@]") & (F.length("t") <= SAMPLE_CHARS)).select("t", F.xxhash64("t").alias("h"))
    # the smallest hashes first, so that only they carry their texts
    least = t.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)
    rows = t.join(F.broadcast(least), "h").dropDuplicates(["h"]).orderBy("h", "t").select("t").collect()
    return fit([r.t for r in rows])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row."""
    found = spans_udf(docs, text_col)
    x = docs.select(F.col(id_col).alias("doc_id"), found(F.coalesce(F.col(text_col), F.lit(""))).alias("f"))
    return x.select("doc_id", *[F.col(f"f.n_{k}").alias(f"n_{k}") for k in KINDS], "f.base_sha256", "f.spans", "f.n_added")


def spans_udf(docs: DataFrame, text_col: str):
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            rows = []
            for base, added in zip(*find(texts, model.value)):
                n = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                rows.append((*n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added), len(added)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            give_back()

    return found


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = [t or "" for t in texts]
            yield pd.Series([mask(t, b + a) for t, b, a in zip(texts, *find(texts, model.value))], dtype=object)
            give_back()

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean(F.coalesce(F.col(text_col), F.lit("")))))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are merged under the kind of the first."""
    out, at, open_end = [], 0, -1
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a < open_end:
            open_end = at = max(open_end, b)
            continue
        out += [text[at:a], f"<{KINDS[k]}>"]
        open_end = at = b
    return "".join(out) + text[at:]
