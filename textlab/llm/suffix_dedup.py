"""Removal of repeated byte strings: a common-prefix-aware distributed merge sort of sampled suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere (in any
text, the same one included) is removed.  All suffixes need not be sorted for that:

* A position is an *anchor* if the 8-byte gram there has the smallest hash among
  ``WINDOW`` neighbouring grams.  Equal LENGTH-byte strings have an anchor at the
  same offset ``t < WINDOW``, so they agree on the LENGTH - t >= LENGTH - WINDOW + 1
  bytes right of it and the t bytes left of it.
* Anchors whose next LENGTH - WINDOW + 1 bytes have a hash that occurs once cannot
  match; a count by hash drops them (exactly: equal bytes have equal hashes).
* The suffixes at the other anchors are sorted: each task sorts the suffixes of
  its texts into runs, keeps equal suffixes with equal left context once, and
  sends the runs front-coded (length of the common prefix with the one before, then the
  rest), dealt by the hash of the bytes that matching suffixes share.  The
  receiving task merges the runs with a loser tree that keeps each run's common prefix
  with the last output and compares only bytes behind it.
* Suffixes that follow each other with a common prefix of at least
  LENGTH - WINDOW + 1 form a group.  For each offset t those members match that
  agree on t bytes to the left and LENGTH - t to the right.  All matching
  strings around one anchor overlap, so only the least and the largest matching t of a
  member count (``extremes``); both come from the common prefixes in suffix order
  and in the order of the left contexts, without comparing bytes again.

Texts with exact copies are removed as a whole (if LENGTH long), and one of
them stands for all when others are compared, so a group of copies of any size is one text.
Suffixes with equal contexts travel once per run.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH keep
all; overlapping repeats count (a long run of one character is removed as a
whole, since its strings start at several places); repeated rows are copies; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, materialize

LENGTH = 400
WINDOW = 200
GRAM = 8
SHARED = LENGTH - WINDOW + 1  # bytes right of an anchor that matching suffixes share at least
RUN = 50_000                  # suffixes sorted into one run
BLOCK = 2_000                 # suffixes in one front-coded block
PART_BYTES = 48 << 20         # suffix bytes merged by one task

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


# ------------------------------------------------------------------ anchors


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_CACHE = {"n": 0, "up": None, "down": None}


def _power_tables(n: int):
    if _CACHE["n"] < n:
        size = max(n, 1 << 16)
        _CACHE.update(n=size, up=_powers(size, _BASE), down=_powers(size, _INVERSE))
    return _CACHE["up"], _CACHE["down"]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions with at least SHARED bytes to their right, and the hash of these bytes."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none
    b = np.frombuffer(data, np.uint8)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams |= b[j:n - GRAM + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    h = grams * _ODD
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    # ties go to the left: equal strings choose equal offsets
    least = _sliding_argmin(h.astype(np.int64), WINDOW)[:n - LENGTH + 1]
    at = np.unique(least)
    at = at[at + SHARED <= n]
    up, down = _power_tables(n + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])
    key = (prefix[at + SHARED] - prefix[at]) * down[at]
    key = (key ^ (key >> np.uint64(31))) * _ODD
    return at, key.view(np.int64)


def _sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the minimum of each window (block prefix and suffix minima)."""
    n = len(h)
    pad = -n % w
    v = np.concatenate([h, np.full(pad, (1 << 32) - 1, np.int64)])
    # 32-bit hashes: value and position in one number, so a minimum is its own argmin
    rows = ((v << 31) | np.arange(len(v))).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1: n]) & ((1 << 31) - 1)


# ------------------------------------------------------------------ runs


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, which is known to be at least ``at``."""
    n = min(len(a), len(b))
    step = 32
    while at < n and a[at:at + step] == b[at:at + step]:
        at += step
        step *= 2
    if at >= n:
        return n
    hi = min(n, at + step)
    while at < hi:  # the first difference is in [at, hi)
        mid = (at + hi) // 2
        if a[at:mid + 1] == b[at:mid + 1]:
            at = mid + 1
        else:
            hi = mid
    return min(at, n)


def front_code(run: list[tuple]) -> Iterator[tuple[list, list, list, list, list]]:
    """Blocks (common prefixes, rests, left contexts, texts, positions) of a sorted run; each block starts anew."""
    for lo in range(0, len(run), BLOCK):
        common, rests, lefts, texts, places, last = [], [], [], [], [], b""
        for suffix, left, occ in run[lo:lo + BLOCK]:
            c = lcp(last, suffix)
            common.append(c)
            rests.append(suffix[c:])
            lefts.append(left)
            texts.append([t for t, _ in occ])
            places.append([p for _, p in occ])
            last = suffix
        yield common, rests, lefts, texts, places


def decode(blocks) -> Iterator[tuple[int, bytes, bytes, list]]:
    """(common prefix with the one before, suffix, left context, occurrences) of one run's blocks in order."""
    before = b""
    for block in blocks:
        last = b""
        for i, (c, rest, left, texts, places) in enumerate(zip(*block)):
            last = last[:c] + rest
            yield lcp(before, last) if i == 0 else c, last, left, list(zip(texts, places))
        before = last


class LoserTree:
    """Merges sorted runs; every run carries the common prefix of its head with the last output.

    Of two heads the one with the longer known prefix is smaller; only when the
    prefixes are equal are bytes compared, and only behind them.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list = [None] * self.k   # (suffix, left, occ)
        self.known = [0] * self.k
        for i in range(len(runs)):
            self._next(i)
            self.known[i] = 0
        self.loser = [0] * self.k
        self.winner = self._build(1)

    def _next(self, i: int) -> None:
        x = next(self.runs[i], None) if i < len(self.runs) else None
        if x is None:
            self.head[i] = None
        else:
            self.known[i], self.head[i] = x[0], x[1:]

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        a, b = self.head[i], self.head[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if self.known[i] != self.known[j]:
            return (i, j) if self.known[i] > self.known[j] else (j, i)
        c = lcp(a[0], b[0], self.known[i])
        if a[0][c:c + 1] <= b[0][c:c + 1]:
            self.known[j] = c
            return i, j
        self.known[i] = c
        return j, i

    def _build(self, at: int) -> int:
        if at >= self.k:
            return at - self.k
        w, self.loser[at] = self._play(self._build(2 * at), self._build(2 * at + 1))
        return w

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, list]]:
        """(common prefix with the last output, suffix, left context, occurrences), sorted."""
        while self.head[self.winner] is not None:
            i = self.winner
            yield (self.known[i], *self.head[i])
            self._next(i)
            at = (i + self.k) // 2
            while at >= 1:
                w, self.loser[at] = self._play(i, self.loser[at])
                i, at = w, at // 2
            self.winner = i


# ------------------------------------------------------------------ groups


def extremes(suffixes: list[bytes], known: list[int], lefts: list[bytes], many: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest t for which a member matches another, or itself elsewhere (``many``); LENGTH and -1 if none.

    Members are sorted by suffix, ``known[i]`` is the common prefix of suffixes i - 1 and i.
    """
    n = len(suffixes)
    sizes, left_sizes = np.fromiter(map(len, suffixes), np.int64, n), np.fromiter(map(len, lefts), np.int64, n)
    low, high = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    itself = np.array(many, bool)
    a, b = np.maximum(LENGTH - sizes, 0), np.minimum(left_sizes, WINDOW - 1)
    itself &= a <= b
    low[itself], high[itself] = a[itself], b[itself]
    if n == 1:
        return low, high
    order = sorted(range(n), key=lefts.__getitem__)
    back = [lcp(lefts[i], lefts[j]) for i, j in zip(order, order[1:])]
    if n == 2:
        a, b = LENGTH - min(known[1], LENGTH), min(back[0], WINDOW - 1)
        if max(a, 0) <= b:
            low, high = np.minimum(low, max(a, 0)), np.maximum(high, b)
        return low, high
    right_lcp = np.append(0, np.minimum(known[1:], LENGTH))
    left_lcp = np.append(0, back)
    by_left = np.array(order)
    left_class = np.empty(n, np.int64)

    def matching(t: int) -> np.ndarray:
        """Members that share (t bytes left, LENGTH - t right) with another."""
        left_class[by_left] = np.cumsum(left_lcp < t)
        both = np.cumsum(right_lcp < LENGTH - t) * (n + 1) + left_class
        at = np.argsort(both, kind="stable")
        same = both[at[1:]] == both[at[:-1]]
        out = np.zeros(n, bool)
        out[at[1:]] = same
        out[at[:-1]] |= same
        return out & (sizes >= LENGTH - t) & (left_sizes >= t)

    # between two lengths at which some common prefix ends nothing changes
    changes = np.unique(np.concatenate([[0, WINDOW - 1], left_lcp, left_lcp + 1, LENGTH - right_lcp, LENGTH - right_lcp - 1]))
    changes = changes[(changes >= 0) & (changes < WINDOW)]
    for t in changes.tolist():
        if (low <= t).all():
            break
        low[matching(t) & (low > t)] = t
    for t in changes[::-1].tolist():
        if (high >= t).all():
            break
        high[matching(t) & (high < t)] = t
    return low, high


def covered(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, end) pieces as maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ------------------------------------------------------------------ operator


def _sorted_runs(parts: int):
    """Texts with candidate anchors -> front-coded blocks of sorted runs, dealt to ``parts``."""

    def blocks(found: dict, run: int):
        by: dict[int, list] = {}
        for (suffix, left), occ in found.items():
            part = int.from_bytes(hashlib.blake2b(suffix[:SHARED], digest_size=4).digest(), "big") % parts
            by.setdefault(part, []).append((suffix, left, occ))
        for part, items in by.items():
            items.sort(key=lambda s: s[:2])
            for seq, block in enumerate(front_code(items)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([seq], pa.int32()), *[pa.array([x], kind) for x, kind in zip(block, _BLOCK)]],
                    names=["part", "run", "seq", *_NAMES])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, found, n = TaskContext.get().partitionId() << 32, {}, 0
        for b in batches:
            for text, data, at in zip(b["no"].to_pylist(), b["data"], b["at"]):
                data, at = data.as_py(), at.as_py()
                for p in at:
                    key = data[p:p + LENGTH], data[max(0, p - WINDOW + 1):p][::-1]
                    found.setdefault(key, []).append((text, p))
                n += len(at)
                if n >= RUN:
                    yield from blocks(found, run)
                    run, found, n = run + 1, {}, 0
        if found:
            yield from blocks(found, run)

    return sort


_NAMES = ["common", "rests", "lefts", "texts", "places"]
_BLOCK = [pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32()))]
_RUNS = "part int, run long, seq int, common array<int>, rests array<binary>, lefts array<binary>, texts array<array<bigint>>, places array<array<int>>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (part, run, seq) -> (no, start, end) of repeated strings.  Blocks are decoded one at a time per run."""

    def rows():
        for b in batches:
            for i, (part, run) in enumerate(zip(b["part"].to_pylist(), b["run"].to_pylist())):
                yield part, run, b.slice(i, 1)

    def unpacked(blocks):
        return ([b[c][0].as_py() for c in _NAMES] for b in blocks)

    for _, part in groupby(rows(), key=lambda r: r[0]):
        runs: dict[int, list] = {}
        for _, run, block in part:
            runs.setdefault(run, []).append(block)
        found: list[tuple[int, int, int]] = []
        for suffixes, known, lefts, occ in _groups(LoserTree([decode(unpacked(r)) for r in runs.values()])):
            low, high = extremes(suffixes, known, lefts, [len(o) > 1 for o in occ])
            for o, a, b in zip(occ, low.tolist(), high.tolist()):
                if a <= b:
                    found += [(no, at - b, at - a + LENGTH) for no, at in o]
            if len(found) > 50_000:
                yield _pieces(found)
                found = []
        if found:
            yield _pieces(found)


def _pieces(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    no, start, end = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["no", "start", "end"])


def _groups(merged) -> Iterator[tuple[list, list, list, list]]:
    """Runs of suffixes that share SHARED bytes as (suffixes, common prefixes, left contexts,
    occurrences); equal contexts are united, and only groups that can match are given."""
    suffixes, known, lefts, occ, seen, least = [], [], [], [], {}, 0
    for common, suffix, left, where in merged:
        if common < SHARED and suffixes:
            if len(suffixes) > 1 or len(occ[0]) > 1:
                yield suffixes, known, lefts, occ
            suffixes, known, lefts, occ, seen = [], [], [], [], {}
        if suffixes and common < len(suffixes[-1]) or len(suffix) != len(suffixes[-1] if suffixes else suffix):
            seen = {}  # another suffix
        least = min(least, common) if suffixes else 0
        at = seen.get(left)
        if at is not None:
            occ[at] += where
            continue
        seen[left] = len(suffixes)
        suffixes.append(suffix)
        known.append(least)
        lefts.append(left)
        occ.append(list(where))
        least = LENGTH
    if len(suffixes) > 1 or suffixes and len(occ[0]) > 1:
        yield suffixes, known, lefts, occ


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b["data"].to_pylist()
            found = [anchors(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([hashlib.md5(d).digest() for d in data], pa.binary()), pa.array([len(d) for d in data], pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                 pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([k for _, k in found], pa.list_(pa.int64()))],
                names=["doc_id", "text", "n_bytes", "sha", "at", "key"])

    marks = materialize(src.mapInArrow(mark, f"doc_id {kind}, text binary, n_bytes long, sha string, at array<int>, key array<bigint>"), "anchors")
    # one row per different text
    distinct = marks.groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("at").alias("at"), F.first("key").alias("key"))
    distinct = materialize(distinct, "texts")
    each = distinct.select("text", "rep", F.explode(F.arrays_zip("at", "key")).alias("x")).select("text", "rep", F.col("x.at").alias("at"), F.col("x.key").alias("key"))
    repeated = each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    # bounded by the text's length
    places = materialize(each.join(repeated, "key").groupBy("text", "rep").agg(F.collect_list("at").alias("at")), "places")
    bodies = src.withColumn("text", F.unhex(F.md5("data")))
    bodies = bodies.filter(id_filter(places, "rep")("doc_id"))
    picked = bodies.join(places, (bodies["text"] == places["text"]) & bodies["doc_id"].eqNullSafe(places["rep"])).select(places["text"], "data", "at")
    # a text's number is written with it
    picked = materialize(picked.dropDuplicates(["text"]).withColumn("no", F.monotonically_increasing_id()), "candidates")
    spark = docs.sparkSession
    size = picked.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * (LENGTH + WINDOW) // PART_BYTES))
    runs = picked.select("no", "data", "at").mapInArrow(_sorted_runs(parts), _RUNS)
    runs = runs.repartition(parts, "part").sortWithinPartitions("part", "run", "seq")
    pieces = runs.mapInArrow(_merge, "no long, start int, end int")
    spans = pieces.groupBy("no").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the text's anchors

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def cut(data: pd.Series, spans_: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s in zip(data, spans_):
            out, kept = covered([(x["start"], x["end"]) for x in s]), []
            at = 0
            for a, b in out:
                kept.append(d[at:a])
                at = b
            kept.append(d[at:])
            kept = b"".join(kept)
            rows.append((len(d) - len(kept), len(out), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])

    partly = picked.select("no", "text", "data").join(spans, "no").select("text", cut("data", "spans").alias("r")).select("text", "r.*")
    whole = distinct.select("text", "copies").filter("copies > 1")
    x = marks.select("doc_id", "text", "n_bytes", "sha").join(whole, "text", "left").join(partly, "text", "left")
    all_ = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    return x.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
