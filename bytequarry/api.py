"""Commands by name, on paths: compress, extract, list, test, repair, benchmark, convert, info."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import detect
from .operators import security
from .plans import archive, reports
from .schema import Options
from .sources import files, packages


def compress(spark: SparkSession, inputs: list[str], path: str, options: Options = Options()) -> dict:
    """Packs files and folders; inputs that do not exist are left out. Sizes, ratio and what was saved."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in map(files.resolve, inputs) if hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p))]
    if not there:
        raise FileNotFoundError(", ".join(inputs))
    found = None
    for p in there:
        part = files.scan(spark, p)
        found = part if found is None else found.unionByName(part)
    head = archive.pack(found, path, options)
    n, m = head["original_bytes"], head["compressed_bytes"]
    return head | {"ratio": n / m if m else 1.0, "saved_percent": 100.0 * (n - m) / n if n else 0.0}


def extract(spark: SparkSession, path: str, target: str, password: str | None = None) -> int:
    """Writes all files below target; every digest is compared first, and a failure writes nothing. Number of files."""
    found = archive.extract(spark, path, password)
    bad = found.filter(F.col("error").isNotNull()).select("path", "error").first()
    if bad:
        from .errors import IntegrityError

        raise IntegrityError(f"{bad['path']}: {bad['error']}")
    archive.write_files(found, target)
    return archive.entries(spark, path).count()


def list_entries(spark: SparkSession, path: str, term: str = "") -> DataFrame:
    return reports.listing(archive.entries(spark, path), term)


def test(spark: SparkSession, path: str, deep: bool = False, password: str | None = None) -> bool:
    return bool(archive.test(spark, path, deep, password).first()["ok"])


def repair(spark: SparkSession, path: str, out: str) -> int:
    """Number of chunks rebuilt; raises if one could not be."""
    done = archive.repair(spark, path, out)
    if done.filter("not mended").limit(1).count():
        from .errors import RecoveryError

        raise RecoveryError("a chunk is damaged beyond its parity")
    return done.count()


def benchmark(spark: SparkSession, path: str, options: Options = Options()) -> dict:
    return reports.benchmark(files.scan(spark, files.resolve(path)).select("content"), "content", options.research)


def convert(spark: SparkSession, package: str, path: str, options: Options = Options()) -> dict:
    return archive.convert(files.scan(spark, files.resolve(package)).select("path", "content"), path, options)


def extract_package(spark: SparkSession, package: str, target: str) -> int:
    """Writes what a foreign package holds below target; unsafe paths and unreadable packages stop it before anything is
    written. Number of files."""
    opened = packages.members(files.scan(spark, files.resolve(package)).select("path", "content"), "path", "content", contents=True)
    safe = security.with_safe_path(opened.filter("is_dir is null or not is_dir").withColumnRenamed("error", "read_error")).withColumn("error", F.coalesce("read_error", "error"))
    bad = safe.filter(F.col("error").isNotNull()).select("package", "error").first()
    if bad:
        from .errors import ByteError

        raise ByteError(f"{bad['package']}: {bad['error']}")
    archive.write_files(safe, target)
    return safe.count()


def info(spark: SparkSession, path: str) -> DataFrame:
    return reports.file_info(files.scan(spark, files.resolve(path)), "path", "content")


def inspect_nested(spark: SparkSession, path: str, max_depth: int = security.MAX_DEPTH) -> DataFrame:
    return packages.nested(files.scan(spark, files.resolve(path)), "path", "content", max_depth)


def detect_type(spark: SparkSession, path: str) -> str:
    return files.scan(spark, files.resolve(path)).select(detect.detected_type(F.col("content")).alias("t")).first()["t"]
