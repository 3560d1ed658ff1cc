"""Alignments that arrive as files: a stream over a landing folder of PAF, appended to a table of blocks.

The inputs of an assembly are files that can be read again, so nothing else here streams. New files are parsed once;
``availableNow`` ends the stream when all that lie there are done, and a checkpoint remembers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandflow.sources.textio import paf_blocks


def blocks_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the PAF files in ``folder``, as they come. ``ord`` is a hash of the line, as a stream has no line
    numbers that outlive a batch."""
    lines = spark.readStream.format("text").load(folder).select(F.xxhash64("value").alias("line"), "value")
    return paf_blocks(lines)


def land(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Append all new files' blocks to the Parquet table at ``table`` and stop."""
    blocks_stream(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
