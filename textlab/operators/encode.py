"""Preparing encoded training pairs.

No pretrained subword tokenizer is available offline, so pairs are encoded
as T6 word tokens against a corpus vocabulary built from the training
split.  Truncation, padding, label masking and decoding keep their meaning.

Id layout: 0 = pad, 1 = unk, vocabulary ids from 2 in order of count
(descending), then token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from ..sources.tables import cluster

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2
IGNORE_ID = -100
SPECIAL_IDS = (PAD_ID, UNK_ID)


PAIR = ["split", "pair_id"]


def pair_tokens(pairs: DataFrame, prefix: str = "", lang: str = "en") -> DataFrame:
    """(split, pair_id, src, tgt) token arrays, clustered by pair; P1 prepends ``prefix`` to the source."""
    p = cluster(pairs.select(*PAIR, "source", "target"), *PAIR)
    src = F.concat(F.lit(prefix), F.col("source")) if prefix else F.col("source")
    return p.select(
        *PAIR,
        T.token_array(T.mark_sentences(src, F.lit(lang))).alias("src"),
        T.token_array(T.mark_sentences("target", F.lit(lang))).alias("tgt"),
    )


def vocab_ids(toks: DataFrame, max_size: int | None = None, split: str = "train") -> DataFrame:
    """(token, id, cnt), ids in order of count (descending), then token.

    All training tokens get an id unless the caller asks for the
    ``max_size`` most frequent.  The numbering is distributed: the counts are
    sorted by ranges, each range numbers its rows, and the sizes of the ranges before it
    (one row per range) are added.
    """
    t = toks.where(F.col("split") == split)
    words = T.explode_rows(t, F.concat("src", "tgt"), "token")
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    order = [F.desc("cnt"), F.asc("token")]
    if max_size is not None:
        counts = counts.orderBy(*order).limit(max_size)
    ranges = int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "token", "cnt", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"))
    local = materialize(local, "vocab-ranges")  # the ranges must not be drawn twice
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return local.join(starts, "part").select("token", (F.col("start") + F.col("pos") + FIRST_ID).cast("int").alias("id"), "cnt")


def encode(toks: DataFrame, vocab: DataFrame, max_source_length: int = 1024, max_target_length: int = 128,
           val_max_target_length: int | None = None) -> DataFrame:
    """(split, pair_id, input_ids, labels), truncated.

    Train labels use ``max_target_length``; val and test use
    ``val_max_target_length`` (default: the same).  Tokens are truncated
    before the lookup (J5, a join whose strategy the optimizer picks by the
    vocabulary's size), so no work is spent on dropped positions.
    """
    val_max = max_target_length if val_max_target_length is None else val_max_target_length
    tgt_max = F.when(F.col("split") == "train", F.lit(max_target_length)).otherwise(F.lit(val_max))

    def tagged(side, tokens):
        return F.transform(tokens, lambda t, p: F.struct(F.lit(side).alias("side"), p.alias("pos"), t.alias("token")))

    x = toks.select(*PAIR, F.inline_outer(F.concat(tagged("i", F.slice("src", 1, max_source_length)),
                                                   tagged("l", F.slice("tgt", F.lit(1), tgt_max)))))
    ids = x.join(vocab.select("token", "id"), "token", "left")

    def fold(side):
        item = F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, item))).getField("id")

    return ids.groupBy(*PAIR).agg(fold("i").alias("input_ids"), fold("l").alias("labels"))


def pad(ids, length: int) -> F.Column:
    """Right-pad an id array with PAD_ID to ``length``."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(length) - F.size(c), F.lit(0))))


def mask_labels(labels) -> F.Column:
    """E5: padding in labels -> -100 (ignored by the loss)."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(c, lambda x: F.when(x == PAD_ID, F.lit(IGNORE_ID)).otherwise(x))


def pad_pairs(enc: DataFrame, max_source_length: int = 1024, max_target_length: int = 128,
              ignore_pad_token_for_loss: bool = True) -> DataFrame:
    """E4 + E5 (padding to max length, optional label masking)."""
    labels = pad("labels", max_target_length)
    if ignore_pad_token_for_loss:
        labels = mask_labels(labels)
    return enc.select("split", "pair_id", pad("input_ids", max_source_length).alias("input_ids"),
                      F.transform(pad("input_ids", max_source_length), lambda x: F.when(x == PAD_ID, 0).otherwise(1))
                      .alias("attention_mask"),
                      labels.alias("labels"))


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, keys=("split", "pair_id"), out: str = "text") -> DataFrame:
    """-100 -> pad, ids -> tokens (special ids skipped), joined by spaces."""
    keys = list(keys)
    x = df.select(*keys, F.posexplode_outer(ids_col).alias("pos", "id"))
    x = x.withColumn("id", F.when(F.col("id") == IGNORE_ID, F.lit(PAD_ID)).otherwise(F.col("id")))
    v = vocab.select(F.col("id").alias("_v_id"), F.col("token").alias("_v_token"))
    j = x.join(v, x["id"] == v["_v_id"], "left")
    item = F.when(F.col("id").isNotNull() & ~F.col("id").isin(*SPECIAL_IDS), F.struct("pos", F.col("_v_token").alias("t")))
    folded = j.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return folded.select(*keys, F.array_join("_s.t", " ").alias(out))


def gen_len(df: DataFrame, ids_col: str, by=()) -> DataFrame:
    """Mean number of non-pad ids."""
    n = F.size(F.filter(ids_col, lambda x: x != PAD_ID))
    return df.groupBy(*by).agg(F.avg(n).alias("gen_len"))


def first_n(df: DataFrame, n: int, order: str = "pair_id", split: str = "split",
            splits=("train", "val", "test")) -> DataFrame:
    """The first n rows of each split in key order (a distributed
    top-k per split, TakeOrderedAndProject; never a bare ``limit``)."""
    parts = [df.where(F.col(split) == s).orderBy(order).limit(n) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
