"""Order MinHash fingerprints from DataFrame functions alone.

A text's items are its word k-mers, each numbered by occurrence (the second
``a b c`` is another item than the first).  Every item gets one hash; the hash
range is cut into ``sketches`` equal ranges, and in each the ``picks`` items
with the smallest hash are selected, put back into text order and hashed as a
tuple.  A moved or edited passage changes the order or the choice of the
picks, so equal tuples witness a small edit distance, not only equal
vocabularies.  The likeness of two fingerprints is the share of equal tuples
among the ranges that hold items in either.

All steps are array functions on the row; finding a hash range in the
sorted items and numbering repeated k-mers are binary searches, so the work per
document is n log n also for very long or very repetitive texts.

The neighbour of a document is the next one by descending id.  Ids are cut into
ranges at approximate quantiles; the first row of each range is also sent to
the range before it, so one shuffle by range and a window inside it serve all rows.

Edge cases: null texts are empty; an empty text has no items (fingerprint of
zeros, likeness 1 to another empty text, else 0); fewer than ``k`` words are
one item; equal texts have equal fingerprints; null ids come last; rows with
one id are ordered by their text's hash; a single row is its own neighbour; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SKETCHES, PICKS = 3, 64, 2
RANGE_BYTES = 16 << 20    # text per id range
MOST_RANGES = 4096        # ranges whose limits the driver holds
_SPACE = r"[\x20\x09-\x0D]+"
_STEPS = [1 << b for b in range(30, -1, -1)]


def _search(n: F.Column, below) -> F.Column:
    """How many leading positions satisfy the monotone test ``below`` (binary lifting)."""
    steps = F.filter(F.array(*[F.lit(s) for s in _STEPS]), lambda s: s <= n)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & below(at + s - 1), at + s).otherwise(at))


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """Adds ``out``: one int per hash range, 0 where the range holds no item."""
    c = lambda s: f"_omh_{s}"
    rest = [x for x in df.columns]
    df = df.select(*rest, F.transform(F.split(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d")), _SPACE),
                                      lambda w: F.xxhash64(w)).alias(c("w")),
                   (F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d")) == "").alias(c("none")))
    w = F.col(c("w"))
    # k-mers: hash of k neighbouring words
    kmers = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))),
                        lambda h, i: F.xxhash64(h, *[F.get(w, i + j) for j in range(1, k)]))
    df = df.select(*rest, F.when(F.col(c("none")), F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(kmers).alias(c("g")))
    g = F.col(c("g"))
    by_gram = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*rest, c("g"), F.when(F.size(F.array_distinct(g)) < F.size(g), by_gram).alias(c("r")))
    r = F.col(c("r"))

    def occurrence(x, j):
        """In the sorted k-mers: how many equal ones stand before position j."""
        before = _search(j, lambda p: F.get(r, j - 1 - p)["h"] == x["h"])
        return F.when(F.get(r, j - 1)["h"] == x["h"], before).otherwise(F.lit(0))

    once = F.transform(g, lambda h, i: F.struct(F.xxhash64(h, F.lit(0)).alias("h"), i.alias("i")))
    numbered = F.transform(r, lambda x, j: F.struct(F.xxhash64(x["h"], occurrence(x, j)).alias("h"), x["i"].alias("i")))
    df = df.select(*rest, F.array_sort(F.when(r.isNull(), once).otherwise(numbered)).alias(c("s")))
    s = F.col(c("s"))
    width = (1 << 64) // sketches
    lows = F.array(*[F.lit(-(1 << 63) + b * width) for b in range(sketches)])
    starts = F.transform(lows, lambda low: _search(F.size(s), lambda p: F.get(s, p)["h"] < low))
    df = df.select(*rest, c("s"), F.concat(starts, F.array(F.size(s))).alias(c("b")))
    at = F.col(c("b"))

    def tuple_hash(b):
        lo, hi = F.get(at, b), F.get(at, b + 1)
        chosen = F.slice(s, lo + 1, F.least(hi - lo, F.lit(picks)))
        ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"], x["h"])))
        return F.when(hi == lo, F.lit(0)).otherwise(F.hash(F.transform(ordered, lambda x: x["h"])).bitwiseOR(F.lit(1)))

    return df.select(*rest, F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), tuple_hash).alias(out))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Share of equal tuples among the hash ranges that hold items in either."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda u: u))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda u: u))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def as_text(a: F.Column) -> F.Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_next(df: DataFrame, sid: str, columns: list[str], tie: str, text_col: str) -> DataFrame:
    """Adds next_<column>: the value in the next row by descending ``sid``; the last row's next is the first."""
    spark = df.sparkSession
    ids = df.select(sid, F.octet_length(text_col).cast("long").alias("n"))
    size, rows = ids.agg(F.sum("n"), F.count("*")).first()
    if not rows:
        return df.select("*", *[F.col(x).alias(f"next_{x}") for x in columns])
    ranges = int(min(MOST_RANGES, max(1, (size or 0) // RANGE_BYTES)))
    cuts = []
    if ranges > 1:
        share = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(ids.agg(F.percentile_approx(sid, share, 20000)).first()[0]))
    limits = F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>")
    bucket = _search(F.lit(len(cuts)), lambda p: F.get(limits, p) < F.col(sid)) if cuts else F.lit(0)
    df = df.withColumn("_bucket", bucket)
    tops = sorted((r[0], r[1]) for r in df.groupBy("_bucket").agg(F.max(sid)).collect())  # one row per range
    copies = [(tops[i - 1][1] if i else tops[-1][1], tops[i][0]) for i in range(len(tops))]
    table = spark.createDataFrame(copies, "_top bigint, _to int").groupBy("_top").agg(F.collect_list("_to").alias("_to"))
    j = df.join(F.broadcast(table), F.col(sid) == F.col("_top"), "left").drop("_top")
    own = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t")))
    more = F.transform(F.coalesce(F.col("_to"), F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(1).alias("t")))
    j = j.withColumn("_at", F.explode(F.concat(own, more))).select("*", "_at.b", "_at.t").drop("_at", "_to", "_bucket")
    order = Window.partitionBy("b").orderBy("t", F.col(sid).desc(), F.col(tie))
    j = j.select("*", *[F.lead(x).over(order).alias(f"next_{x}") for x in columns])
    return j.filter("t = 0").drop("b", "t")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    x = x.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("sid"), F.xxhash64("txt").alias("tie"))
    x = with_next(with_fingerprint(x, "txt", "fp"), "sid", ["txt", "fp"], "tie", "txt")
    third = F.floor(F.length("txt") / 3).cast("int")
    edited = F.concat(F.substring("txt", F.lit(1), F.length("txt") - third), F.substring("next_txt", F.lit(1), third))
    x = x.select("doc_id", F.length("txt").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    x = x.select("doc_id", "n_chars", "edited", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    x = with_fingerprint(x, "edited", "efp").drop("edited")
    return x.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
