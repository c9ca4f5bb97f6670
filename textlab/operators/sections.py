"""T12/T13 section segmentation with spans.

Every non-overlapping match of the title pattern starts a section that runs
to the next match (or the end of the text).  Text before the first match
becomes section 0 titled "[UNNAMED]" (no title span); a text without any
match has no sections.  Spans are 0-based code-point offsets, end exclusive.

Titles come from ``regexp_extract_all`` (group 0 and group 1), bodies from
``split`` on the same pattern (one more piece than titles; the first piece
is the preamble).  Offsets are running sums of the lengths in the document's
row, the successor is the next array element: no window, no exchange.

Patterns are written as in Python: ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are Unicode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

SECTION_COLUMNS = [
    "doc_id", "index", "start", "end", "title", "title_normalized",
    "title_start", "title_end", "text", "text_start", "text_end",
]


def section_arrays(docs: DataFrame, pattern: str = R.DEFAULT_TITLE_PATTERN, first_title: str = R.UNNAMED_TITLE,
                   text: str = "text") -> DataFrame:
    """(doc_id, secs, starts): the sections of each document as an array of
    (pre, title, norm, body), preamble first when there is one."""
    t, java = F.col(text), "(?U)" + pattern  # Java's classes are ASCII without the flag
    parts = docs.select(
        "doc_id",
        F.regexp_extract_all(t, F.lit(java), 0).alias("titles"),
        F.regexp_extract_all(t, F.lit(java), 1).alias("norms"),
        F.split(t, java, -1).alias("bodies"),
    )
    item = "struct<pre:boolean,title:string,norm:string,body:string>"
    pre = F.element_at("bodies", 1)
    zipped = F.arrays_zip(
        F.transform("titles", lambda x: F.lit(False)).alias("pre"),
        F.col("titles").alias("title"),
        F.col("norms").alias("norm"),
        F.slice("bodies", 2, F.greatest(F.size("bodies"), F.lit(1))).alias("body"),
    ).cast(f"array<{item}>")
    preamble = F.when(
        (F.size("titles") > 0) & (F.length(pre) > 0),
        F.array(F.struct(F.lit(True).alias("pre"), F.lit(first_title).alias("title"),
                         F.lit(first_title).alias("norm"), pre.alias("body")).cast(item)),
    ).otherwise(F.array().cast(f"array<{item}>"))
    secs = parts.select("doc_id", F.concat(preamble, zipped).alias("secs"))
    return secs.select("doc_id", "secs", T.running_starts(F.transform("secs", lambda s: _title_length(s) + F.length(s["body"]))).alias("starts"))


def _title_length(s):
    return F.when(s["pre"], F.lit(0)).otherwise(F.length(s["title"]))


def sections(docs: DataFrame, pattern: str = R.DEFAULT_TITLE_PATTERN, first_title: str = R.UNNAMED_TITLE,
             text: str = "text") -> DataFrame:
    """One row per section, with SECTION_COLUMNS."""
    arr = section_arrays(docs, pattern, first_title, text)
    rows = arr.select("doc_id", "starts", F.posexplode_outer("secs").alias("index", "s")).where("s IS NOT NULL")
    start = F.get("starts", F.col("index"))
    x = rows.select("doc_id", "index", "s", start.alias("start"), (start + _title_length(F.col("s"))).alias("text_start"))
    end = F.col("text_start") + F.length("s.body")
    return x.select(
        "doc_id", "index", "start", end.alias("end"),
        F.col("s.title").alias("title"),
        F.col("s.norm").alias("title_normalized"),
        F.when(~F.col("s.pre"), F.col("start")).alias("title_start"),
        F.when(~F.col("s.pre"), F.col("text_start")).alias("title_end"),
        F.col("s.body").alias("text"),
        "text_start", end.alias("text_end"),
    )


def next_section(docs: DataFrame, pattern: str = R.DEFAULT_TITLE_PATTERN, fill: str | None = None) -> DataFrame:
    """Each section's normalized title with the one of its successor (padded with ``fill``)."""
    arr = section_arrays(docs, pattern)
    titles = arr.select("doc_id", F.transform("secs", lambda s: s["norm"]).alias("norms"))
    rows = titles.select("doc_id", "norms", F.posexplode_outer("norms").alias("index", "title_normalized")).where("index IS NOT NULL")
    nxt = F.when(F.col("index") + 1 < F.size("norms"), F.get("norms", F.col("index") + 1)).otherwise(F.lit(fill))
    return rows.select("doc_id", "index", "title_normalized", nxt.alias("next_title"))
