"""Documents and usage records as they arrive.

The batch operators are used as they are: reading files, summing usage. State is bounded by the
watermark; late rows beyond it are dropped, as a stream must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import packages


def arriving_files(
    spark: SparkSession, folder: str, most_files: int = 1000, most_bytes: int = packages.MOST_BYTES
) -> DataFrame:
    """A stream of the files that come into a folder, with their format and errors; larger files than
    ``most_bytes`` have an error and no content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = (
        spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files)
        .option("recursiveFileLookup", "true").load(folder)
    )
    fmt = packages.route(F.col("path"), packages.FORMATS)
    error = F.when(fmt == "unsupported", "unsupported format").when(F.col("length") > most_bytes, "file too large")
    return rows.select(
        packages.X.stable_id("doc_", F.col("path")).alias("document_id"), "path", fmt.alias("source_format"), "length",
        error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"),
    )


def arriving_blocks(files: DataFrame) -> DataFrame:
    """The blocks of arriving files."""
    return packages.read_blocks(files)


def usage_by_window(usage: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records and words by owner and window of creation; repeated records count once."""
    return (
        usage.withWatermark("created_at", late)
        .dropDuplicatesWithinWatermark(["usage_id"])
        .groupBy(F.window("created_at", window), "owner_user_id")
        .agg(F.count("*").alias("record_count"), F.sum(F.coalesce("word_count", F.lit(0))).alias("word_count"))
        .select(F.col("window.start").alias("window_start"), "owner_user_id", "record_count", "word_count")
    )
