"""Stateless text clean-up on a streaming source.

The reference has no streaming operator.  Its narrow expressions (strip,
clean-up, sentence and token splitting) hold no state, so the same Column
functions apply unchanged to a streaming DataFrame: new prediction files
dropped into a folder are cleaned and appended to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def clean_prediction_stream(spark: SparkSession, input_dir: str) -> DataFrame:
    """Streaming (path, text) with N1 + N5 applied to each line."""
    lines = spark.readStream.format("text").load(input_dir)
    return lines.select(F.col("_metadata.file_path").alias("path"),
                        T.tokenization_cleanup(T.strip("value")).alias("text"))


def start_cleanup(spark: SparkSession, input_dir: str, output_dir: str, available_now: bool = True,
                  checkpoint: str | None = None) -> StreamingQuery:
    """Append cleaned lines to parquet.  The checkpoint belongs to the output
    (by default a hidden folder in it), so a restarted query resumes."""
    ckpt = checkpoint or f"{output_dir.rstrip('/')}/_cleanup_checkpoint"
    w = clean_prediction_stream(spark, input_dir).writeStream.format("parquet").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w
    return w.outputMode("append").start(output_dir)
