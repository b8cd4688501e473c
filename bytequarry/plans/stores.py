"""Two denser layouts: chunk stores, where equal content-defined chunks of all files are coded once, and solid blocks, where small
neighbouring files are coded as one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from . import archive

SOLID_BYTES = 1 << 20
_MEMBERS = pa.list_(pa.struct([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())]))


def store_chunks(files: DataFrame, path: str, path_col: str = "path", content_col: str = "content") -> None:
    """Writes path/recipes (recipe_id, path, size, sha256, chunks: digests in order) and path/chunks (sha256, method, payload, ...).

    Only distinct chunks are coded. Repeated paths and repeated rows have a recipe each; null contents are empty."""
    spark = files.sparkSession
    content = F.coalesce(F.col(content_col), F.lit(b"").cast("binary"))
    rows = files.select(F.col(path_col).cast("string").alias("path"), content.alias("content")).withColumn("at", udfs.cdc_chunks(F.col("content")))
    part = lambda a: F.substring("content", (a["offset"] + 1).cast("int"), a["length"].cast("int"))
    # A file's own chunks stay within its row: an array of digests, without an exchange.
    digests = F.transform("at", lambda a: F.sha2(part(a), 256))
    rows.select(F.monotonically_increasing_id().alias("recipe_id"), "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), digests.alias("chunks")).write.mode("overwrite").parquet(f"{path}/recipes")
    listed = spark.read.parquet(f"{path}/recipes").select("path", F.posexplode("chunks").alias("place", "sha256"))
    cut = rows.select("path", "content", F.posexplode("at").alias("place", "a")).select("path", "place", part(F.col("a")).alias("content")).withColumn("sha256", F.sha2("content", 256))
    distinct = archive.one_of_each(cut, listed, "sha256", ["path", "place"])
    coded = distinct.select("sha256", F.octet_length("content").cast("long").alias("original_size"), archive.encode(F.col("content")).alias("c"))
    coded.select("sha256", "original_size", F.octet_length("c.payload").cast("long").alias("compressed_size"), F.crc32("c.payload").alias("crc32"), F.col("c.method").alias("method"), F.col("c.payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/chunks")


def restore_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content, error) of every recipe."""
    decoded = spark.read.parquet(f"{path}/chunks").select("sha256", archive.decode(F.col("method"), F.col("payload")).alias("d")).select(F.col("sha256").alias("chunk"), "d.content", F.col("d.error").alias("chunk_error"))
    recipes = spark.read.parquet(f"{path}/recipes")
    wanted = recipes.select("recipe_id", "path", "size", "sha256", F.posexplode_outer("chunks").alias("place", "chunk"))
    parts = wanted.join(decoded, "chunk", "left")
    whole = parts.groupBy("recipe_id", "path", "size", "sha256").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("parts"), F.max("chunk_error").alias("chunk_error"))
    joined = F.aggregate(F.transform("parts", lambda p: p["content"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(b"").cast("binary"))))
    out = whole.select("path", "size", "sha256", joined.alias("content"), "chunk_error")
    error = F.when(F.sha2("content", 256) != F.col("sha256"), F.coalesce("chunk_error", F.lit("sha256 differs")))
    return out.select("path", "size", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def _join(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, members, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | serial], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([members], _MEMBERS)], ["block", "content", "members"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                if held and size + len(data) > limit:
                    yield block()
                    serial, held, members, size = serial + 1, [], [], 0
                members.append({"path": path, "offset": size, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
                held.append(data)
                size += len(data)
        if members:
            yield block()

    return run


def solid_blocks(files: DataFrame, limit: int = SOLID_BYTES, path_col: str = "path", content_col: str = "content", partitions: int | None = None) -> DataFrame:
    """(block, content, members): files in order of path, joined until a block would pass the limit; a larger file has its own."""
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content"))
    ranged = rows.repartitionByRange(partitions, "path") if partitions else rows.repartitionByRange("path")
    return ranged.sortWithinPartitions("path").mapInArrow(_join(limit), "block bigint, content binary, members array<struct<path:string,offset:bigint,size:bigint,sha256:string>>")


def pack_solid(files: DataFrame, path: str, limit: int = SOLID_BYTES, research: bool = False, **how) -> None:
    """Writes path/blocks: one coded payload for each block, with its members."""
    coded = solid_blocks(files, limit, **how).select("block", "members", archive.encode(F.col("content"), research).alias("c"))
    coded.select("block", "members", F.col("c.method").alias("method"), F.crc32("c.payload").alias("crc32"), F.col("c.payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/blocks")


def extract_solid(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content, error) of every member; a block is decoded once."""
    decoded = spark.read.parquet(f"{path}/blocks").select("members", archive.decode(F.col("method"), F.col("payload")).alias("d"))
    each = decoded.select(F.explode("members").alias("m"), F.col("d.content").alias("block"), F.col("d.error").alias("block_error"))
    out = each.select("m.path", "m.size", "m.sha256", F.expr("substring(block, int(m.offset) + 1, int(m.size))").alias("content"), "block_error")
    error = F.coalesce("block_error", F.when(F.sha2("content", 256) != F.col("sha256"), "sha256 differs"))
    return out.select("path", "size", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))
