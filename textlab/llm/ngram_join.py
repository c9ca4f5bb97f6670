"""N-gram Jaccard join with a count-vector R-tree, and its components.

Texts are compared as sets of word shingles; two link when
``den * |A and B| >= num * |A or B|``.

* Equal sets are one *node*; only nodes are compared, however many copies there are.
* A node's shingles are hashed into ``GROUPS`` groups; the counts per group are a
  point.  Two sets share at most the sum of the coordinate minima of their
  points, and a set shares at most the sum of the minima with a box's upper
  corner with anything inside the box (``CountRTree``).
* Trees are built per *key*: under one order of all shingles (those frequent in a
  sample last, then by hash) two linking nodes share one of their first
  ``n - ceil(t n) + 1`` shingles, so nodes meet in the groups of these keys and
  no link is lost.  The order never changes a result, only the group sizes.
* Groups above ``BLOCK`` nodes are cut into blocks that meet pairwise.
* A key group emits no pairs but a *forest*: edges that connect the nodes whose bounds allow a link,
  at most one for each node.  Round one takes every ``FIRST``-th key (by hash), round two all keys
  whose nodes are still apart.  Linking nodes thus end in one *cluster*.
* The sets of a cluster travel once and are verified together: in one call, or, above ``SETS`` sets or
  ``BIN_BYTES`` bytes, in blocks that meet pairwise.  The tree over the cluster gives the pairs not yet
  connected there, exact overlaps decide, and a forest of the links leaves the call.  A pair left out is
  inside a component already, so the components are exact.
* The sets are made again from the texts of the nodes that need one; a bitmap of fixed size drops the
  other texts inside the scan (an exact join follows), and of repeated rows one set is kept.

Shingles are 64-bit hashes, sets 128-bit hashes of them.

Edge cases: null, empty and blank texts have no shingles and link with
nothing; fewer than ``k`` words are one shingle; repeated rows are copies of
one node; a null id counts as larger than all others (null only if all are);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_filter, materialize

GROUPS = 128         # coordinates of a point (large sets: more)
LEAF = 32            # points in a leaf
BLOCK = 4096         # nodes of a key group that one call compares
SAMPLE_ROWS = 4000   # texts whose shingles decide what counts as frequent (order only)
MOST_FREQUENT = 1 << 16
PART_EDGES = 1_000_000  # edges contracted by one task
BIN_BYTES = 16 << 20  # sets of one block, or of the small clusters of one bin
SETS = 2000          # sets of one block of a cluster
PIVOTS = 4           # nodes that are compared with their whole group before its tree is searched
FIRST = 8            # share of the keys that round one uses

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LETTER = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)  # 3 modulo 4


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of lower-cased UTF-8 text."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    begin = ~space
    begin[1:] &= space[:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return start, np.empty(0, np.uint64)
    at = np.arange(start[0], len(b)) - start[np.cumsum(begin[start[0]:]) - 1]
    value = _LETTER[b[start[0]:]] * _powers(int(at.max()) + 1)[at]
    value[space[start[0]:]] = 0
    return start, _finish(np.add.reduceat(value, start - start[0]))


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode().lower() if t else b"" for t in texts]
    start, h = word_hashes(b"\n".join(raw))
    limits = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raw]))
    n = max(len(h) - k + 1, 0)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = (s ^ h[j:j + n]) * _MIX[j % 5] + _MIX[(j + 1) % 5]
    s = _finish(s)
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
        if b - a >= k:
            x = np.sort(s[a:b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"short" + h[a:b].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def point(s: np.ndarray) -> bytes:
    """Shingles per group, in the smallest integers that hold them (first byte: their size).

    Large sets get more groups (16 shingles in one on average, a power of two of them), because
    the bound is as tight as the groups are empty; modulo GROUPS they fold into a point of GROUPS coordinates.
    """
    groups = GROUPS
    while groups * 16 < len(s):
        groups *= 2
    n = np.bincount((s >> np.uint64(24)).astype(np.int64) % groups, minlength=groups)
    size = 1 if n.max() < 1 << 8 else 2 if n.max() < 1 << 16 else 4
    return bytes([size]) + n.astype(f"<u{size}").tobytes()


class Points:
    """Points of GROUPS coordinates (rows of ``coarse``) and the finer ones they come from."""

    def __init__(self, packed: list[bytes]):
        self.fine = [np.frombuffer(p, f"<u{p[0]}", offset=1) for p in packed]
        self.coarse = np.empty((len(packed), GROUPS), np.int32)
        for i, f in enumerate(self.fine):
            self.coarse[i] = f if len(f) == GROUPS else f.reshape(-1, GROUPS).sum(axis=0)
        self.wide = np.fromiter((len(f) > GROUPS for f in self.fine), bool, len(packed))

    def bound(self, i: int, j: int) -> int:
        """Sum of coordinate minima at the finest grouping that both have."""
        a, b = self.fine[i], self.fine[j]
        g = min(len(a), len(b))
        return int(np.minimum(a.reshape(-1, g).sum(axis=0, dtype=np.int64), b.reshape(-1, g).sum(axis=0, dtype=np.int64)).sum())

    def refine(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of the pairs (rows i, j) may still link by the finer points."""
        keep = np.ones(len(i), bool)
        for q in np.flatnonzero(self.wide[i] & self.wide[j]):
            x, y = int(i[q]), int(j[q])
            keep[q] = (num + den) * self.bound(x, y) >= num * int(n[x] + n[y])
        return keep


class KeyOrder:
    """The order of all shingles: frequent ones last, then by hash."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.frequent >> np.uint64(44)).astype(np.int64)] = True

    def keys(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        n = len(s)
        p = n - -(-num * n // den) + 1
        rank = _finish(s ^ _MIX[4]) >> np.uint64(1)
        at = np.flatnonzero(self.maybe[(s >> np.uint64(44)).astype(np.int64)])
        if len(at):
            pos = np.searchsorted(self.frequent, s[at])
            at = at[self.frequent[np.minimum(pos, len(self.frequent) - 1)] == s[at]]
            rank[at] |= np.uint64(1 << 63)
        return s if p >= n else s[np.argpartition(rank, p - 1)[:p]]


class CountRTree:
    """Bulk-loaded tree of boxes over count points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple] = []  # (upper corner, least size, rows or None, left, right)
        self.order: list[np.ndarray] = []
        self.root = self._load(np.arange(len(points)))

    def _load(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        p = self.points[rows]
        corner, least = p.max(axis=0), int(self.sizes[rows].min())
        if len(rows) <= LEAF:
            self.order.append(rows)
            self.nodes[at] = (corner, least, rows, -1, -1)
            return at
        axis = int((corner - p.min(axis=0)).argmax())
        half = rows[np.argpartition(p[:, axis], len(rows) // 2)] if len(rows) > LEAF else rows
        left, right = self._load(half[: len(rows) // 2]), self._load(half[len(rows) // 2:])
        self.nodes[at] = (corner, least, None, left, right)
        return at

    def search(self, queries: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, found rows) whose overlap bound allows a link; queries are rows of the tree."""
        stack = [(self.root, queries)]
        while stack:
            at, q = stack.pop()
            corner, least, rows, left, right = self.nodes[at]
            bound = np.minimum(self.points[q], corner).sum(axis=1)
            q = q[(num + den) * bound >= num * (self.sizes[q] + least)]
            if not len(q):
                continue
            if rows is None:
                stack += [(left, q), (right, q)]
                continue
            for part in np.array_split(q, -(-len(q) // 2048)):
                slack = self.slack(part[:, None], rows[None, :], num, den)
                i, j = np.nonzero(slack >= 0)
                yield part[i], rows[j]

    def slack(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        return (num + den) * np.minimum(self.points[a], self.points[b]).sum(axis=-1) - num * (self.sizes[a] + self.sizes[b])


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(points, sizes, label, side, num: int, den: int, links) -> Iterator[tuple[int, int]]:
    """Edges that connect the rows of one group as far as ``links`` does, at most one for each label.

    ``label`` names what is connected already; ``links(i, rows)`` tells which of ``rows`` link with row i and is asked only
    for pairs that the bound allows and that are not connected yet.  If ``side`` has several values,
    only pairs across sides count (those of one side meet elsewhere).
    """
    label = np.unique(label, return_inverse=True)[1].astype(np.int64)
    cross = side.min() != side.max()
    apart = lambda i, rows: rows[(label[rows] != label[i]) & ((side[rows] != side[i]) if cross else True)]

    def join(i: int, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Connect row i with those of ``rows`` that link with it."""
        rows = apart(i, rows)
        rows = rows[links(i, rows)] if len(rows) else rows
        new, first = np.unique(label[rows], return_index=True)
        if len(new):
            label[np.isin(label, new)] = label[i]
            yield from ((i, int(j)) for j in rows[first])

    if (label == label[0]).all():
        return
    tree = CountRTree(points, sizes)
    everyone = np.arange(len(points))
    if len(points) > LEAF:  # near copies hang together after a few rows
        centre = np.abs(points - np.median(points, axis=0)).sum(axis=1)
        for _ in range(PIVOTS):
            i = int(centre.argmin())
            rows = apart(i, everyone)
            yield from join(i, rows[tree.slack(np.full(1, i), rows, num, den) >= 0])
            centre[label == label[i]] = np.inf
            if not np.isfinite(centre).any():
                break
    values, counts = np.unique(label, return_counts=True)
    if len(values) == 1:
        return
    outside = everyone[label != values[counts.argmax()]]  # a pair apart has an end outside the largest component
    for part in np.array_split(outside, -(-len(outside) // 256)):
        if (label == label[0]).all():
            return
        for i, j in tree.search(part, num, den):
            use = (label[i] != label[j]) & ((side[i] != side[j]) if cross else True)
            i, j = i[use], j[use]
            turn = np.argsort(i, kind="stable")
            i, j = i[turn], j[turn]
            for s, e in zip(*_runs(i)):
                yield from join(int(i[s]), j[s:e])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal values."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(x))[:len(starts)]


def _key_forests(num: int, den: int):
    """Arrow batches sorted by (key, block) -> edges between nodes that the bound lets link; a group may span batches."""

    def process(t: pa.Table, starts: np.ndarray):
        t = t.combine_chunks()
        node, packed, n, comp, side = t["node"].to_numpy(), Points(t["point"].to_pylist()), t["n"].to_numpy().astype(np.int64), t["comp"].to_numpy(), t["side"].to_numpy()
        points = packed.coarse
        ends = np.append(starts[1:], len(node))
        edges = []
        two = starts[ends - starts == 2]
        if len(two):  # most groups are pairs: one vector operation for all
            a, b = two, two + 1
            use = ((num + den) * np.minimum(points[a], points[b]).sum(axis=1) >= num * (n[a] + n[b])) & (comp[a] != comp[b])
            a, b = a[use], b[use]
            use = packed.refine(a, b, n, num, den)
            edges.append(np.stack([a[use], b[use]]))
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s > 2:
                r = slice(s, e)
                links = lambda i, rows: packed.refine(np.full(len(rows), i + s), rows + s, n, num, den)  # noqa: E731, B023
                found = np.array(list(_forest(points[r], n[r], comp[r], side[r], num, den, links)), np.int64).reshape(-1, 2)
                edges.append(found.T + s)
        if edges:
            x, y = np.concatenate(edges, axis=1)
            found = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
            if not len(t):
                continue
            key, block = t["key"].to_numpy(), t["block"].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            if len(starts) > 1:
                yield from process(t.slice(0, starts[-1]), starts[:-1])
            rest = t.slice(starts[-1])
        if rest is not None and len(rest):
            yield from process(rest, np.zeros(1, np.int64))
        give_back()

    return run


def set_links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the exact links between sorted sets (pairs across sides, if there are several)."""
    n = np.array([len(s) for s in sets], np.int64)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.append(0, np.cumsum(n))
    mark = np.zeros(len(known), bool)

    def links(i: int, rows: np.ndarray) -> np.ndarray:
        own = ids[at[i]:at[i + 1]]
        mark[own] = True
        both = np.fromiter((np.count_nonzero(mark[ids[at[j]:at[j + 1]]]) for j in rows.tolist()), np.int64, len(rows))
        mark[own] = False
        return den * both >= num * (n[i] + n[rows] - both)

    points = Points([point(s) for s in sets]).coarse
    return list(_forest(points, n, np.arange(len(sets)), side, num, den, links))


def _verify(num: int, den: int):
    """Rows (cluster, low, high, side, node, hashes) of one bin -> links; each (cluster, low, high) is verified by itself."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cluster", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")]).combine_chunks()
        cluster, low, high, side, node = (t[c].to_numpy() for c in ("cluster", "low", "high", "side", "node"))
        edges = []
        new = (cluster[1:] != cluster[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(np.append(True, new)) if len(node) else np.empty(0, np.int64)
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist()):
            if e - s > 1:
                sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in t["hashes"].slice(s, e - s)]
                edges += [(node[s + i], node[s + j]) for i, j in set_links(sets, side[s:e], num, den)]
        give_back()
        return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], schema=_EDGES)

    return run


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one part contracted: each node with the smallest node it reaches there.

    Every label that meets a smaller one takes the smallest; at least half of those that meet any are gone after a round.
    """
    ends = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    u, v = (np.concatenate([e[i] for e in ends]) if ends else np.empty(0, np.int64) for i in (0, 1))
    del ends
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = at[:len(u)], at[len(u):], np.arange(len(names))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    inner = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[inner]), pa.array(names[label[inner]])], names=["u", "v"])
    del u, v, at, x, y, label, inner, names
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge (a, b); ``comp`` is the smallest node.

    Parts of at most PART_EDGES edges are contracted to stars by themselves; as
    long as there are several parts, a large-star and a small-star step bring
    their stars together and the parts are contracted again.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    before = None
    while True:
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        parts = -(-now[0] // PART_EDGES)
        if not now[0] or now == before:
            break
        stars = e.repartition(parts).mapInArrow(_local_stars, "u long, v long")
        if parts == 1:
            e = materialize(stars, "edges")
            break
        before, stars = now, materialize(stars, "edges")
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionAll(low.select("u", F.col("m").alias("v")))
        e = small.distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def frequent_shingles(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """Shingles of a bounded sample that occur in at least 0.5 % of it; they only come last in the key order."""
    total = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(1), text_col), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(text_col).alias("t"))

    def count(batches):
        for b in batches:
            h, n = np.unique(np.concatenate([*shingles(b["t"].to_pylist(), k), np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    least = max(3, int(0.005 * min(total, SAMPLE_ROWS)))
    rows = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def near_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node, comp for every row; comp is null where nothing links by another text."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(KeyOrder(frequent_shingles(docs, k, text_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                sets = shingles(part["t"].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([point(s) for s in sets], pa.binary()),
                     pa.array([order.value.keys(s, num, den).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set", "point", "keys"])
            give_back()

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    feats = materialize(src.mapInArrow(features, f"doc_id {kind}, n long, set binary, point binary, keys array<bigint>"), "shingle-keys")
    nodes = feats.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("keys").alias("keys"))
    # a node's number is written with it, so it is the same wherever it is read
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    # linking sets differ in size by num / den at most, so by one class at most (the margin covers rounding)
    keyed = keyed.withColumn("c", F.floor(F.log("n") / F.lit(max(math.log(den / num) * (1 + 1e-6), 1e-6))).cast("int"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m"), F.collect_set("c").alias("cs")).filter("m >= 2")
    near = F.exists("cs", lambda x: F.abs(x - F.col("c")) == 1)
    keyed = materialize(keyed.join(shared, keyed["key"] == shared["k"]).filter((F.col("m") > F.size("cs")) | near).select("node", "key", "m"), "shared-keys")

    def forests(c: DataFrame) -> DataFrame:
        """c: key, node, m, comp.  A group of m nodes is cut into blocks of about BLOCK; each two blocks meet."""
        c = c.withColumn("s", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        c = c.withColumn("block", F.least("side", "other").cast("long") * (1 << 31) + F.greatest("side", "other"))
        c = c.join(nodes.select("node", "n", "point"), "node").select("key", "block", "node", "side", "n", "point", "comp")
        c = c.repartition("key", "block").sortWithinPartitions("key", "block")
        return materialize(c.mapInArrow(_key_forests(num, den), "a long, b long").distinct(), "forest")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                sets = shingles(part["t"].to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["doc_id", "set", "hashes"])
            give_back()

    def verified(cluster: DataFrame) -> DataFrame:
        """A forest of the links inside the clusters (node, cluster)."""
        need = materialize(cluster.join(nodes.select("node", "set", "rep", "n"), "node"), "needed-sets")
        size = 8 * F.sum("n")
        sizes = need.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / SETS, size / BIN_BYTES)).cast("int").alias("s"))
        total = 8 * (need.agg(F.sum("n")).first()[0] or 0)
        bins = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BIN_BYTES))
        place = need.join(sizes, "cluster").withColumn("side", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        place = place.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
        # small clusters share a bin, each two blocks of a large one have their own
        own = F.xxhash64("cluster", "low", "high")
        place = place.select("node", "cluster", "low", "high", "side", F.when(F.col("s") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(own).alias("bin"))
        texts = src.filter(id_filter(need, "rep")("doc_id")).mapInArrow(whole_sets, f"doc_id {kind}, set binary, hashes binary")
        sets = texts.join(need, (texts["set"] == need["set"]) & texts["doc_id"].eqNullSafe(need["rep"])).groupBy("node").agg(F.first("hashes").alias("hashes"))
        return materialize(sets.join(place, "node").groupBy("bin").applyInArrow(_verify(num, den), "a long, b long"), "links")

    one = forests(keyed.filter(F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0).withColumn("comp", F.col("node")))
    now = keyed.join(components(one), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    two = forests(now.join(split, "key"))
    comp = components(verified(components(one.unionAll(two)).withColumnRenamed("comp", "cluster")))
    return feats.select("doc_id", F.col("n").alias("n_shingles"), "set").join(nodes.select("set", "node"), "set", "left").drop("set").join(comp, "node", "left")


def _slices(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for i in range(0, len(b), rows))


def ngram_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    x = near_groups(docs, k, num, den, id_col, text_col).withColumn("label", F.coalesce("comp", "node"))
    x = materialize(x.select("doc_id", "n_shingles", "label"), "labels")
    low = x.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("low"), F.count("*").alias("c")).filter("c > 1")
    return x.join(low, "label", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
