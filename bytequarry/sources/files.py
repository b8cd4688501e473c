"""File scans: paths, metadata and contents as rows."""

from __future__ import annotations

import os
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE_MODE


OPEN_BYTES = 1 << 16
"""What opening a file counts for at most when files are dealt to tasks. Spark's 4 MB would make a task of every few small files."""


def _contents(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    """Spark's own rows of files, planned in a copy of the session, where opening a file counts for OPEN_BYTES at most."""
    copy = spark._jsparkSession.cloneSession()
    cost = copy.sessionState().conf().filesOpenCostInBytes()
    copy.conf().set("spark.sql.files.openCostInBytes", str(min(cost, OPEN_BYTES)))
    reader = copy.read().format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return DataFrame(reader.load(root), spark)


def _empty_files(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Files without bytes, which Spark's file sources list but leave out: taken from the listing that found has made.

    The listing is sorted by length where it is, as only the empty files may cost a call from Python each."""
    jvm = spark.sparkContext._jvm
    named = jvm.java.lang.Class.forName
    kind = jvm.java.lang.invoke.MethodType.methodType(jvm.java.lang.Long.TYPE)
    length = jvm.java.lang.invoke.MethodHandles.publicLookup().findVirtual(named("org.apache.hadoop.fs.FileStatus"), "getLen", kind)
    by_length = jvm.java.util.Comparator.comparingLong(jvm.java.lang.invoke.MethodHandleProxies.asInterfaceInstance(named("java.util.function.ToLongFunction"), length))
    listed = found._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().allFiles()
    files, rows = jvm.java.util.ArrayList(jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed)), []
    jvm.java.util.Collections.sort(files, by_length)
    for f in files:
        if f.getLen():
            break
        if not f.getPath().getName().startswith(("_", ".")):
            rows.append((f.getPath().toString(), f.getModificationTime() // 1000))
    out = spark.createDataFrame(rows, "path string, seconds bigint")
    return out.select("path", F.timestamp_seconds("seconds").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def scan(spark: SparkSession, root: str, pattern: str | None = None, empty: bool = True) -> DataFrame:
    """(path, is_dir, size, created_at, modified_at, mode, is_symlink, symlink_target, content) of a file or of all files
    below a folder, paths relative to it. Columns that are not asked for are not read; contents least of all.

    With empty, files without bytes are listed too; with a pattern they are not."""
    base = F.lit(root.rstrip("/") + "/")
    full = F.regexp_replace("path", "^[a-zA-Z]+:/+", "/")
    at = F.instr(full, base)
    relative = F.when(at > 0, F.substr(full, at + F.length(base))).otherwise(F.element_at(F.split("path", "/"), -1))
    found = _contents(spark, root, pattern)
    # First in the union is what belongs to the session itself, so that all further steps are planned in it.
    others = _empty_files(spark, found) if empty and not pattern else spark.createDataFrame([], found.schema)
    return others.unionByName(found).select(
        relative.alias("path"), F.lit(False).alias("is_dir"), F.col("length").alias("size"), F.lit(0).cast("long").alias("created_at"),
        F.unix_timestamp("modificationTime").alias("modified_at"), F.lit(FILE_MODE).alias("mode"), F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("symlink_target"), "content",
    )


def resolve(path: str) -> str:
    """An existing path as given, else below the working folder, its parent or its grandparent; else as given."""
    if os.path.isabs(path) or os.path.exists(path):
        return path
    here = Path.cwd()
    return next((str(p / path) for p in (here, *list(here.parents)[:2]) if (p / path).exists()), path)


def system_info(spark: SparkSession) -> DataFrame:
    """One row: parallelism, operating system, Spark's version and the working folder."""
    return spark.range(1).select(F.lit(spark.sparkContext.defaultParallelism).alias("threads"), F.lit(platform.system().lower()).alias("os"), F.version().alias("version"), F.lit(os.getcwd()).alias("cwd"))
