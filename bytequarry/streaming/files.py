"""Structured Streaming: files as they arrive, detected, digested and stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import detect
from ..plans import archive
from ..schema import Options

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified_at, size, detected_type, sha256, content) of new files below root."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), detect.detected_type(F.col("content")).alias("detected_type"), F.sha2("content", 256).alias("sha256"), "content")


def first_seen(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Contents not seen within the watermark's delay; state holds digests only as long as that."""
    return files.withWatermark("modified_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def store(files: DataFrame, path: str, checkpoint: str, options: Options = Options(password=None, recovery_percent=0)) -> StreamingQuery:
    """Appends what arrives to an archive at path, until what has arrived is done: entries of every file, and coded chunks of the
    contents that no earlier batch holds, so that archive.extract gives all files back.

    A batch that is run again after a failure writes to its own folders again, so nothing is stored twice. Only digests of stored
    chunks are read to tell what is new."""

    def save(batch: DataFrame, number: int) -> None:
        archive.append(batch, path, number, options)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
