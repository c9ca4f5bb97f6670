"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring, every document one position.
A document belongs to the first point clockwise of it; when that point's
shard is full, it continues clockwise to the next shard with room.  The
capacities add up to the number of rows and differ by one row at most, so all
shards end exactly full: row counts are at most one apart, while only the
overflow leaves its home shard.

How it runs: the rows of each arc (the stretch before one point) are counted
with a map-side combine; the walk around the ring then works on these
``shards * vnodes`` counts alone (a bound that does not depend on the data)
and gives each arc a short list of (shard, rows) segments.  A row's rank in its
arc picks its segment and its slot.  One shuffle of narrow rows, no text.

Edge cases: a null id takes its position from the text; a null text has no
bytes (size 16, crc32 of nothing = 0); rows that agree in id, position, size
and crc32 may swap slots; an empty table gives no rows; extra columns of the
input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROW_OVERHEAD = 16  # bytes a row counts for besides its text


def ring_points(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring positions (signed 64 bit) and the shard that owns each."""
    points = []
    for s in range(n_shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(h, "big", signed=True), s))
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def capacities(home: np.ndarray, total: int) -> np.ndarray:
    """Rows per shard, at most one apart; the larger ones go where most keys are at home."""
    n = len(home)
    cap = np.full(n, total // n, dtype=np.int64)
    cap[np.argsort(-home, kind="stable")[: total % n]] += 1
    return cap


def walk(counts: np.ndarray, owner: np.ndarray, cap: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, rows, shard) of a clockwise walk.

    Home rows fill a shard first; what does not fit moves on with the walk and
    is taken, oldest first, by the next points whose shard has room.
    """
    free = cap.copy()
    segments, waiting, taken = [], deque(), np.zeros(len(counts), dtype=np.int64)
    for arc, n in enumerate(counts):
        k = int(min(n, free[owner[arc]]))
        if k:
            segments.append((arc, 0, k, int(owner[arc])))
            free[owner[arc]] -= k
        taken[arc] = k
    left = counts - taken
    while left.any() or waiting:
        for arc in range(len(counts)):
            s = owner[arc]
            while waiting and free[s] > 0:
                src, n = waiting.popleft()
                k = int(min(n, free[s]))
                segments.append((src, int(taken[src]), k, int(s)))
                taken[src] += k
                free[s] -= k
                if n > k:
                    waiting.appendleft((src, n - k))
            if left[arc]:
                waiting.append((arc, int(left[arc])))
                left[arc] = 0
    return segments


def ring_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, home_shard, shard, slot for every row."""
    spark = docs.sparkSession
    points, owner = ring_points(n_shards, vnodes)
    where = spark.sparkContext.broadcast(points)

    @F.pandas_udf(T.IntegerType())
    def arc_of(pos: pd.Series) -> pd.Series:
        at = np.searchsorted(where.value, pos.to_numpy(), side="left")
        return pd.Series(np.where(at == len(where.value), 0, at).astype(np.int32))

    pos = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    counts = np.zeros(len(points), dtype=np.int64)
    nulls = docs.filter(F.col(id_col).isNull()).select(F.xxhash64(text_col).alias("pos"))
    keyed = docs.filter(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("pos"))
    for arc, n in keyed.unionAll(nulls).select(arc_of("pos").alias("arc")).groupBy("arc").count().collect():
        counts[arc] = n  # one number per ring point
    home = np.bincount(owner, weights=counts, minlength=n_shards).astype(np.int64)
    segments = walk(counts, owner, capacities(home, int(counts.sum())))
    filled = [0] * n_shards
    rows = []
    for arc, first, n, s in segments:
        rows.append((arc, first, first + n, s, filled[s], int(owner[arc])))
        filled[s] += n
    table = spark.createDataFrame(rows, "arc int, lo long, hi long, shard int, base long, home_shard int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        pos.alias("pos"),
    ).withColumn("arc", arc_of("pos"))
    order = Window.partitionBy("arc").orderBy("pos", "doc_id", "size", "text_crc32")
    x = x.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # at most two segments per ring point on average: small by construction
    j = x.join(F.broadcast(table), "arc").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return j.select("doc_id", "size", "text_crc32", "home_shard", "shard",
                    (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def plan_moves(keys: list[int], before: int, after: int, vnodes: int = 128) -> int:
    """How many of ``keys`` (ring positions) change their home shard between two shard counts."""
    (p, o), (q, r) = ring_points(before, vnodes), ring_points(after, vnodes)
    at = lambda pts, own, k: own[bisect.bisect_left(pts, k) % len(pts)]
    p, q = p.tolist(), q.tolist()
    return sum(at(p, o, k) != at(q, r, k) for k in keys)
