"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

* Texts and items are compared lower-cased (A-Z) with white space collapsed, as UTF-8
  bytes (an edit is one byte).
* Windows of an item start at each of its bytes, windows of a document at every few bytes
  (1 to 4, by class), wherever its words begin: a copy holds windows of both
  sides at the same places, also in text without spaces.
* One CGK random walk runs over each window: step ``j`` outputs the character
  under the pointer, and a random bit for (j, character) moves the pointer on.  A
  few edits shift the two walks against each other only until they fall into step
  again, so a small edit distance becomes a small Hamming distance of the outputs.
* LSH tables sample output steps.  The class of an item (length of its walks) and its number of
  tables follow from its length alone: the longest walks that find ``RECALL`` of random
  copies with as many edits as the limit allows (``plan``, estimated on ``PLANTED`` copies).
  A walk of n steps reads n bytes at most, so an exact copy is always found; the last class outputs
  every byte of a window that any copy within 0.1 edits per byte must hold unchanged.
* Hits whose window lacks too many of the item's grams are dropped, which loses none within the limit.
* Each hit is verified exactly: the smallest edit distance between the item and
  any substring of the item-sized window of the document (bit-parallel), at most
  ``ratio`` of the item's length.

Items are used in slices of at most ``SLICE_BYTES``, each with its own pass over the documents,
so what is broadcast is bounded however many items there are.  Documents are
never shuffled.

Edge cases: null and empty texts leak nothing; items of under ``LEAST_ITEM``
normalised characters are too short to be told from chance and give no rows;
repeated items and rows are each reported; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import give_back

RATIO = 0.1                  # edits per byte of the item that still count as a leak
RECALL = 0.98                # least recall at RATIO that the number of tables is derived from
LEAST_ITEM = 24
CLASSES = ((28, 4, 14), (24, 2, 16), (16, 1, 12), (8, 1, 8), (6, 1, 6))  # steps of a walk, bytes between windows of a document, sampled steps
MOST_TABLES = 8              # LSH tables a class may need; the next class is used beyond that
PLANTED = 400                # random copies that recall is estimated from
SLICE_BYTES = 1 << 20        # an index holds some 100 bytes for each
GRAM = 4                     # bytes of a gram in the test before the exact verification
GRAM_BITS = 12
TOGETHER = 300               # texts searched together
CHUNK = 1 << 15              # windows walked together (fits the cache)
SEED = 20_011


def normalise(text: str | None) -> bytes:
    return b" ".join(text.encode().lower().split()) if text else b""


class _Walk:
    """The shared randomness of the walks and tables of one class."""

    def __init__(self, steps: int, samples: int):
        rng = np.random.default_rng((SEED, steps))
        self.moves = rng.integers(0, 2, (steps, 256)).astype(np.intp)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.at: dict[int, list[int]] = {}  # step -> tables that sample it
        for t in range(MOST_TABLES):
            for j in rng.choice(steps, samples, replace=False):
                self.at.setdefault(int(j), []).append(t)

    def keys(self, buf: np.ndarray, starts: np.ndarray, tables: int) -> np.ndarray:
        """(tables, windows) LSH keys; a walk of n steps reads n bytes at most."""
        out = np.zeros((tables, len(starts)), np.uint64)
        out += np.arange(1, len(out) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        factor, ptr = np.uint64(0xD6E8FEB86659FD93), starts.astype(np.intp)
        for j, moves in enumerate(self.moves):
            c = buf.take(ptr, mode="clip")
            if j in self.at:
                v = self.value.take(c)
                for t in self.at[j]:
                    if t < tables:
                        out[t] *= factor
                        out[t] += v
            ptr += moves.take(c)
        return out


_WALKS = [_Walk(steps, samples) for steps, _, samples in CLASSES]


def _copy(rng: np.random.Generator, item: np.ndarray, edits: int) -> np.ndarray:
    t = item.tolist()
    for kind, c in zip(rng.integers(0, 3, edits), rng.integers(0, 256, edits).tolist()):
        at = int(rng.integers(0, max(1, len(t))))
        t[at:at + (kind != 2)] = [c] if kind else []
    return np.array(t, np.uint8)


@lru_cache(maxsize=None)
def _plan(length: int, edits: int) -> tuple[int, int]:
    """(class, tables) for items of ``length`` bytes: the longest class with at most MOST_TABLES tables that
    finds RECALL of random copies with ``edits`` random edits at random places of a text; else the last class
    with all tables."""
    for k, (steps, stride, _) in enumerate(CLASSES):
        if length < steps + stride - 1:
            continue  # an exact copy would not hold a window for sure
        rng = np.random.default_rng((SEED, length, edits))
        item = rng.integers(0, 256, (PLANTED, length), dtype=np.uint8)
        parts, who = [], []
        for i in range(PLANTED):
            parts += [rng.integers(0, 256, 64 + int(rng.integers(0, stride)), dtype=np.uint8), _copy(rng, item[i], edits)]
            who.append(np.full(len(parts[-2]) + len(parts[-1]), i, np.uint64))
        text, who = np.concatenate([*parts, np.zeros(64, np.uint8)]), np.concatenate(who)
        place = np.arange(0, len(who), stride)
        offset = (np.arange(PLANTED)[:, None] * length + np.arange(length - steps + 1)).ravel()
        mix = np.uint64(0xC2B2AE3D27D4EB4F)
        there = _WALKS[k].keys(text, place, MOST_TABLES) ^ who[place] * mix
        here = _WALKS[k].keys(item.ravel(), offset, MOST_TABLES) ^ (offset // length).astype(np.uint64) * mix
        found = np.zeros(PLANTED, bool)
        for t in range(MOST_TABLES):
            found[who[place[np.isin(there[t], here[t])]].astype(int)] = True
            if found.mean() >= RECALL:
                return k, t + 1
    return len(CLASSES) - 1, MOST_TABLES


def plan(length: int, ratio: float) -> tuple[int, int]:
    """``_plan`` of an item at the limit; from 64 bytes on by the lower end of its band, with the edits rounded up."""
    low = length if length < 64 else min(length // 32 * 32, 256)
    return _plan(low, min(low, int(ratio * length) if low == length else math.ceil(ratio * low)))


def distance(item: bytes, window: bytes) -> int:
    """Smallest edit distance between ``item`` and any substring of ``window`` (Myers' bit vectors)."""
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    m, pv, mv, full = len(item), (1 << len(item)) - 1, 0, (1 << len(item)) - 1
    score = best = m
    top = 1 << (m - 1)
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, score)
    return best


def _gram_hash(buf: np.ndarray) -> np.ndarray:
    """GRAM_BITS bits of the GRAM bytes from each place of ``buf`` on (all but its last GRAM - 1)."""
    n, h = max(0, len(buf) - GRAM + 1), np.uint32(0)
    for i in range(GRAM):
        h = (h + buf[i:i + n].astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h & np.uint32((1 << GRAM_BITS) - 1)).astype(np.int32)


class _Tables:
    """LSH tables of the items of one class: sorted keys with the place of each in the joined items."""

    def __init__(self, keys: np.ndarray, at: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order].astype(np.int32)
        self.shift = np.uint64(64 - min(27, max(10, len(keys).bit_length() + 5)))
        self.bits = np.zeros(1 << 64 - int(self.shift), bool)
        self.bits[(keys >> self.shift).astype(np.intp)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column of ``keys``, place in the joined items) of all equal keys."""
        col, at = [], []
        for row in keys:
            c = np.flatnonzero(self.bits.take((row >> self.shift).astype(np.intp)))
            lo = np.searchsorted(self.keys, row[c])
            n = np.searchsorted(self.keys, row[c], side="right") - lo
            col.append(np.repeat(c, n))
            at.append(self.at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(col), np.concatenate(at)


class ItemIndex:
    """LSH tables of one slice of items.  What is found of an item depends on that item alone."""

    def __init__(self, items: list[tuple], ratio: float):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= LEAST_ITEM]
        self.ratio = ratio
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.most = np.array([int(ratio * len(t)) for _, t in self.items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        buf = np.frombuffer(b"".join(t for _, t in self.items) + bytes(GRAM), np.uint8)
        self.grams = _gram_hash(buf)
        plans = np.array([plan(len(t), ratio) for _, t in self.items]).reshape(-1, 2)
        self.tables: dict[int, tuple[int, _Tables]] = {}
        for k in np.unique(plans[:, 0]).tolist():
            mine, steps = np.flatnonzero(plans[:, 0] == k), CLASSES[k][0]
            keys, at = [], []
            for n in mine.tolist():
                places = np.arange(self.first[n], self.first[n] + self.size[n] - steps + 1)
                x = _WALKS[k].keys(buf, places, int(plans[n, 1]))
                keys.append(x.ravel())
                at.append(np.tile(places, len(x)))
            self.tables[k] = int(plans[mine, 1].max()), _Tables(np.concatenate(keys), np.concatenate(at))

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, edits) of a batch: candidates that pass the verification, with the
        fewest edits of their places."""
        joined = b"\n".join(texts)
        if not self.items or not joined:
            return
        buf = np.frombuffer(joined + bytes(8), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = ends - [len(t) + 1 for t in texts]
        best: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int, int]] = set()  # item, place, text
        grams = None
        for k, (tables, held) in self.tables.items():
            start = np.arange(0, len(joined), CLASSES[k][1])
            for lo in range(0, len(start), CHUNK):
                part = start[lo:lo + CHUNK]
                col, at = held.find(_WALKS[k].keys(buf, part, tables))
                if not len(col):
                    continue
                n = np.searchsorted(self.first, at, side="right") - 1
                pair = np.unique(np.stack([n, part[col] - at + self.first[n], np.searchsorted(ends, part[col], side="right")]), axis=1)
                if grams is None:
                    grams = _gram_hash(buf)
                n, place, d = pair[:, self.alike(grams, *pair, begins, ends)].tolist()
                for i, p, j in zip(n, place, d):
                    if (i, p, j) in tried or best.get((j, i)) == 0:
                        continue
                    tried.add((i, p, j))
                    found = self.verify(texts[j], p - int(begins[j]), i)
                    if found is not None:
                        best[j, i] = min(found, best.get((j, i), found))
        for (j, i), found in best.items():
            yield j, i, found

    def alike(self, grams: np.ndarray, n: np.ndarray, place: np.ndarray, d: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Columns whose windows have enough of their item's grams: an edit destroys GRAM of them at
        most, all others are in the window (hashes can only add some)."""
        out, none = [], 1 << GRAM_BITS
        lo = np.maximum(place - self.most[n], begins[d])
        hi = np.minimum(place + self.size[n] + self.most[n], ends[d] - 1) - GRAM + 1
        order, i = np.argsort(self.size[n], kind="stable"), 0
        while i < len(order):
            widest = int(self.size[n[order[min(len(order), i + 256) - 1]]] * 3)
            c = order[i:i + max(1, min(256, (1 << 20) // widest))]
            i += len(c)
            there = np.zeros((len(c), none + 1), bool)
            row = np.arange(len(c))[:, None]
            w = lo[c, None] + np.arange(max(1, int((hi - lo)[c].max())))
            there[row, np.where(w < hi[c, None], grams.take(w, mode="clip"), none)] = True
            there[:, none] = False
            size = self.size[n[c], None] - GRAM + 1
            g = np.arange(int(size.max()))
            has = there[row, np.where(g < size, self.grams.take(self.first[n[c], None] + g, mode="clip"), none)].sum(axis=1)
            out.append(c[has >= size[:, 0] - self.most[n[c]] * GRAM])
        return np.concatenate(out) if out else np.zeros(0, np.intp)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """``hits`` over any number of texts, a few at a time."""
        for lo in range(0, len(texts), TOGETHER):
            for d, n, k in self.hits([normalise(t) for t in texts[lo:lo + TOGETHER]]):
                yield lo + d, n, k

    def verify(self, text: bytes, at: int, n: int) -> int | None:
        item, most = self.items[n][1], int(self.most[n])
        window = text[max(0, at - most):max(0, at + len(item) + most)]
        if item in window:
            return 0
        k = distance(item, window)
        return k if k <= most else None


def item_slices(items: DataFrame, ratio: float, item_col: str, item_text: str) -> Iterator:
    """Broadcast indexes over slices of about SLICE_BYTES of items, one after another."""
    its = items.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    slices = -(-(its.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0) // SLICE_BYTES)
    for s in range(slices):
        part = its if slices == 1 else its.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s)
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in part.orderBy("i", "t").collect()], ratio))


def leaks(docs: DataFrame, items: DataFrame, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (doc_id, item_id) with a leak: distance (edits) and item_chars."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    arrow_item = to_arrow_type(items.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, item_chars int"
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    out = None
    for index in item_slices(items, ratio, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                ids, rows = b["doc_id"].to_pylist(), []
                for d, n, k in x.search(b["t"].to_pylist()):
                    rows.append((ids[d], x.items[n][0], k, len(x.items[n][1])))
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1], arrow_item), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                                                 names=["doc_id", "item_id", "distance", "item_chars"])
                give_back()

        found = src.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, ratio: float = RATIO, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with the same columns; nothing is shuffled."""
    for index in item_slices(items, ratio, item_col, item_text):
        docs = docs.filter(~_leaky(index)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _leaky(index):
    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for d, _, _ in index.value.search(texts.tolist()):
                out[d] = True
            yield pd.Series(out)
            give_back()

    return leaky
