"""S1/S2/S7/S8 with a line index: line files are numbered once and then read in one scan.

``files.read_lines`` numbers lines by counting the rows of every input split, so a
file is scanned twice at each use.  Here :func:`index_lines` counts the lines of byte splits
once and writes one row per split (file, start, end, number of its first line) to a table; a
data source plans one task per split from that table and numbers lines as it reads them.
No join and no window touch the lines, the index serves any number of reads, and line
totals (the alignment check) come from it without reading a file.

A split owns the lines that start in it and reads on to the end of the last one, so splits may
cut lines and even a \\r\\n.  Lines end at \\n, \\r\\n or \\r; the byte order mark of a file is dropped
and bytes that are not UTF-8 become U+FFFD.  Files are read uncompressed, through the file
systems that pyarrow opens.  An empty file has no lines; a file that changed in length after
it was indexed is an error.

The index has one row per SPLIT_BYTES of text; a row is about 100 bytes, so the planner sees
about 100 MB of rows for 128 TB of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..operators.evaluation import Eval
from ..session import scratch_path
from .files import run_names
from .tables import SPLIT_BYTES

FORMAT = "textlab_lines"
LINES_SCHEMA = "line_no bigint, line string"
SPLITS_SCHEMA = "file string, length bigint, start bigint, end bigint"
CHUNK_BYTES = 4 << 20
LF, CR = 10, 13
BOM = b"\xef\xbb\xbf"


def _locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/x, hdfs://h/x, /x) and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(quote(path, safe="/:@"))


def _chunks(file: str, length: int, start: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(position, bytes, offsets in them at which a line starts) from ``start`` to the end of the file."""
    system, path = _locate(file)
    with system.open_input_file(path) as f:
        if f.size() != length:
            raise ValueError(f"{file} has {f.size()} bytes, {length} when it was indexed")
        f.seek(max(start - 1, 0))
        before = f.read(1) if start else b"\n"
        f.seek(start)
        while data := f.read(CHUNK_BYTES):
            seen = np.frombuffer(before + data, np.uint8)
            last, here = seen[:-1], seen[1:]
            yield start, data, np.flatnonzero((last == LF) | ((last == CR) & (here != LF)))
            start += len(data)
            before = data[-1:]


def count_starts(file: str, length: int, start: int, end: int) -> int:
    """Lines that start at a byte in [start, end)."""
    n = 0
    for pos, _, starts in _chunks(file, length, start):
        n += int(np.searchsorted(starts, end - pos))
        if pos + CHUNK_BYTES >= end:
            break
    return n


def split_lines(file: str, length: int, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that start in [start, end), whole, in lists of about CHUNK_BYTES."""
    held: list[bytes] = []  # pieces of the line that the chunks so far have not ended
    open_line = False
    for pos, data, starts in _chunks(file, length, start):
        own = starts[: np.searchsorted(starts, end - pos)]
        stop = int(starts[len(own)]) if len(own) < len(starts) else None  # the first start beyond the split
        first = 0
        if not open_line:
            if not len(own):
                if stop is not None or pos + len(data) >= end:
                    return
                continue
            first, own, open_line = int(own[0]), own[1:], True
        cut = stop if stop is not None else int(own[-1]) if len(own) else first
        if cut > first:
            yield b"".join([*held, data[first:cut]]).splitlines()
            held = []
        elif cut == first and (stop is not None or len(own)) and held:
            yield b"".join(held).splitlines()
            held = []
        if stop is not None:
            return
        held.append(data[cut:])
    if held:
        yield b"".join(held).splitlines()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [count_starts(r["file"], r["length"], r["start"], r["end"]) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n"])


class LineSplit(InputPartition):
    def __init__(self, file: str, length: int, start: int, end: int, first_line: int):
        super().__init__(None)
        self.file, self.length, self.start, self.end, self.first_line = file, length, start, end, first_line


class _Reader(DataSourceReader):
    def __init__(self, index: str):
        self.index = index

    def partitions(self) -> list[LineSplit]:
        system, path = _locate(self.index)
        rows = pads.dataset(path, filesystem=system, format="parquet").to_table().to_pylist()
        # a reader must have a partition
        return [LineSplit(**{k: v for k, v in r.items() if k != "n"}) for r in rows if r["n"]] or [LineSplit("", 0, 0, 0, 0)]

    def read(self, split: LineSplit) -> Iterator[pa.RecordBatch]:
        if not split.length:
            return
        line_no, bom = split.first_line, split.start == 0
        for lines in split_lines(split.file, split.length, split.start, split.end):
            if bom:
                lines[0] = lines[0].removeprefix(BOM)
                bom = False
            try:
                text = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            numbers = pa.array(np.arange(line_no, line_no + len(lines), dtype=np.int64))
            line_no += len(lines)
            yield pa.RecordBatch.from_arrays([numbers, text], names=["line_no", "line"])


class LineFiles(DataSource):
    """``spark.read.format("textlab_lines").option("index", path)``: (line_no, line)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> _Reader:
        if "index" not in self.options:
            raise ValueError("option index: the table that index_lines wrote")
        return _Reader(self.options["index"])


def index_lines(spark: SparkSession, path: str, to: str | None = None, split_bytes: int = SPLIT_BYTES) -> str:
    """Counts the lines of one file, or of a folder of part files (in name order), and writes the index.

    Returns the index's path (``to``, or a new table below the checkpoint folder).  Spark lists the
    files without reading them, and each task counts one split.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint")))
    splits = files.select(F.col("path").alias("file"), "length", starts.alias("start"))
    splits = splits.select("file", "length", "start", F.least("length", F.col("start") + split_bytes).alias("end"))
    counted = splits.repartition(max(splits.count(), 1), "file", "start").mapInArrow(_count_batches, f"{SPLITS_SCHEMA}, n bigint")
    to = to or scratch_path(spark, "line-index")
    raw = scratch_path(spark, "line-counts")
    counted.write.mode("overwrite").parquet(raw)
    counted = spark.read.schema(f"{SPLITS_SCHEMA}, n bigint").parquet(raw)
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = counted.groupBy("file").agg(F.sum("n").alias("lines"))
    totals = totals.select("file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("file_first"))
    index = counted.withColumn("in_file", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(totals, "file")
    index.select("file", "length", "start", "end", (F.col("file_first") + F.col("in_file")).alias("first_line"), "n").write.mode("overwrite").parquet(to)
    return to


def read_indexed(spark: SparkSession, index: str, strip: bool = True) -> DataFrame:
    """(line_no, line) of the indexed files, the rows of ``files.read_lines``, in one scan."""
    spark.dataSource.register(LineFiles)
    lines = spark.read.format(FORMAT).option("index", index).load()
    return lines.select("line_no", (T.strip("line") if strip else F.col("line")).alias("line"))


def count_indexed(spark: SparkSession, index: str) -> int:
    """Lines of the indexed files, from the index alone."""
    return spark.read.parquet(index).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_runs_indexed(spark: SparkSession, paths: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """Name -> index of each run's file."""
    return {name: index_lines(spark, path) for name, path in run_names(paths).items()}


def eval_indexed(spark: SparkSession, orig: str, ref: str, runs: Mapping[str, str]) -> Eval:
    """The files behind the indexes joined by line number; each is read once.

    Files of unequal numbers of lines are an error, found before any file is read.
    """
    counts = {name: count_indexed(spark, index) for name, index in {"": orig, " ": ref, **runs}.items()}
    if len(set(counts.values())) > 1:
        n_orig, n_ref = counts.pop(""), counts.pop(" ")
        raise ValueError(f"files are not aligned: {n_orig} originals, {n_ref} references, runs {counts}")
    rows = read_indexed(spark, orig).withColumnRenamed("line", "orig")
    for col, index in {"ref": ref, **{f"y{i}": index for i, index in enumerate(runs.values())}}.items():
        rows = rows.join(read_indexed(spark, index).withColumnRenamed("line", col), "line_no")
    rows = rows.select(F.lit("").alias("split"), F.col("line_no").alias("pair_id"), "orig", "ref", *[f"y{i}" for i in range(len(runs))])
    return Eval(rows, tuple(runs))
