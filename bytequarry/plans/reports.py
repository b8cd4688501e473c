"""Reports: progress, compression by method, listings and their text and JSON forms."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, detect
from ..operators import running
from . import archive


def progress(entries: DataFrame, order_col: str, size_col: str, buckets: int = 64) -> DataFrame:
    """(order, phase, bytes_processed, total_bytes, percent_complete) of each entry as its coding begins: the sum of all before
    it by order, as percent of the total (100 if that is 0).

    One running sum over a table would be one task; operators.running sums ranges of the order apart."""
    total = entries.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("total_bytes"))  # one row
    placed = running.with_sum_before(entries, order_col, size_col, "bytes_processed", buckets=buckets).crossJoin(F.broadcast(total))
    percent = F.when(F.col("total_bytes") > 0, F.col("bytes_processed") * 100.0 / F.col("total_bytes")).otherwise(100.0)
    return placed.select(F.col(order_col), F.lit("Compressing").alias("phase"), "bytes_processed", "total_bytes", percent.alias("percent_complete"))


def phases(total_bytes: int, recovery: bool) -> list[tuple[str, int, float]]:
    """(phase, bytes_processed, percent) of an archive's other reports."""
    return [("Analyzing", 0, 0.0), *([("GeneratingRecovery", total_bytes, 95.0)] if recovery else []), ("Complete", total_bytes, 100.0)]


def file_info(files: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """(path, name, size, is_dir, detected_type, entropy): type and entropy of the first 8192 bytes; where the rows have a column
    is_dir, folders are of type Directory, size 0 and entropy 0."""
    head = F.substring(F.col(content_col), 1, detect.PROBE)
    if "is_dir" in files.columns:
        folder = F.coalesce("is_dir", F.lit(False))
        name = F.element_at(F.split(F.rtrim(F.col(path_col).cast("string"), F.lit("/")), "/"), -1)
        size = F.when(folder, F.lit(0)).otherwise(F.octet_length(content_col)).cast("long")
        kind = F.when(folder, "Directory").otherwise(detect.detected_type(F.col(content_col)))
        return files.select(F.col(path_col).cast("string").alias("path"), name.alias("name"), size.alias("size"), folder.alias("is_dir"), kind.alias("detected_type"), F.when(folder, 0.0).otherwise(detect.entropy(head)).alias("entropy"))
    return files.select(F.col(path_col).cast("string").alias("path"), F.element_at(F.split(F.col(path_col).cast("string"), "/"), -1).alias("name"), F.octet_length(content_col).cast("long").alias("size"), F.lit(False).alias("is_dir"), detect.detected_type(F.col(content_col)).alias("detected_type"), detect.entropy(head).alias("entropy"))


def by_method(df: DataFrame, content_col: str, research: bool = False, group: F.Column | None = None) -> DataFrame:
    """(grp, method, files, original_bytes, compressed_bytes, ratio, saved_percent) of the smallest codings of all rows.

    Equal contents are coded once and counted as often as they occur."""
    grp = (group if group is not None else F.lit("all")).alias("grp")
    counted = df.select(grp, F.sha2(content_col, 256).alias("sha256"), F.col(content_col).alias("content")).groupBy("grp", "sha256").agg(F.count("*").alias("n"), F.first("content").alias("content"))
    coded = counted.select("grp", "n", F.octet_length("content").cast("long").alias("original"), archive.encode(F.col("content"), research).alias("c"))
    out = coded.groupBy("grp", F.col("c.method").alias("method")).agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("original")).alias("original_bytes"), F.sum(F.col("n") * F.octet_length("c.payload")).alias("compressed_bytes"))
    return out.withColumn("ratio", F.round(columns.ratio(F.col("original_bytes"), F.col("compressed_bytes")), 6)).withColumn("saved_percent", F.round(columns.saved_percent(F.col("original_bytes"), F.col("compressed_bytes")), 6))


def benchmark(df: DataFrame, content_col: str, research: bool = False) -> dict:
    """Sizes, ratio, speed and losslessness of coding all rows; seconds are wall time of the whole job, never from inside it."""
    started = time.time()
    coded = df.select(F.col(content_col).alias("content"), archive.encode(F.col(content_col), research).alias("c"))
    back = coded.select(F.octet_length("content").alias("n"), F.octet_length("c.payload").alias("m"), "content", archive.decode(F.col("c.method"), F.col("c.payload")).alias("d"))
    row = back.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.bool_and(F.col("d.content") == F.col("content")), F.lit(True)).alias("same")).first()
    seconds = time.time() - started
    return {"original_bytes": row["n"], "compressed_bytes": row["m"], "ratio": row["n"] / row["m"] if row["m"] else 1.0, "lossless": row["same"], "seconds": seconds, "mb_per_second": round(row["n"] / 1e6 / seconds, 2)}


def listing(entries: DataFrame, term: str = "") -> DataFrame:
    """(path, size, is_dir) of the entries whose path holds the term in any case; a blank term keeps all."""
    kept = entries.filter(F.lower("path").contains(term.strip().lower())) if term.strip() else entries
    return kept.select("path", "size", "is_dir")


def as_json(df: DataFrame) -> DataFrame:
    """One line of JSON for each row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def as_text(entries: DataFrame) -> DataFrame:
    """One line of text for each entry: kind, size, path."""
    return entries.select(F.format_string("%s %12d %s", F.when(F.col("is_dir"), "d").otherwise("f"), "size", "path").alias("line"))
