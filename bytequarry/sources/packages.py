"""Foreign packages in binary columns: ZIP, TAR, GZIP, BZIP2, XZ and Zstandard, routed by their first bytes."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FormatError, SecurityError
from ..functions import detect
from ..operators import security
from ..plans import shared
from ..schema import FILE_MODE

Member = tuple[str, bool, int, Callable[[], bytes]]


def _zip(data: bytes) -> Iterator[Member]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            yield i.filename, i.is_dir(), i.file_size, lambda i=i: z.read(i)


def _tar(data: bytes) -> Iterator[Member]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for i in t:
            if i.isfile() or i.isdir():
                yield i.name, i.isdir(), i.size, lambda i=i: t.extractfile(i).read() if i.isfile() else b""


def _single(unpack: Callable[[bytes, int], bytes]):
    def members(data: bytes) -> Iterator[Member]:
        content = unpack(data, security.MAX_BYTES)
        yield "content", False, len(content), lambda: content

    return members


def _limited(open_: Callable) -> Callable[[bytes, int], bytes]:
    def unpack(data: bytes, limit: int) -> bytes:
        with open_(io.BytesIO(data)) as f:
            out = f.read(limit + 1)
        if len(out) > limit:
            raise SecurityError(f"expands to more than {limit} bytes")
        return out

    return unpack


READERS: list[tuple[str, Callable[[bytes], Iterator[Member]]]] = [
    ("ZipArchive", _zip),
    ("TarArchive", _tar),
    ("GzipArchive", _single(_limited(lambda f: gzip.open(f)))),
    ("Bzip2Archive", _single(_limited(lambda f: bz2.open(f)))),
    ("XzArchive", _single(_limited(lambda f: lzma.open(f)))),
    ("ZstdArchive", _single(_limited(lambda f: zstandard.ZstdDecompressor().stream_reader(f)))),
]
"""By detected type; the first that fits a row reads it."""


OWN_MAGICS: list[tuple[str, bytes]] = []


def register(kind: str, reader: Callable[[bytes], Iterator[Member]], magic: bytes | None = None) -> None:
    """Adds a reader for a detected type or, with a magic, for a type of its own; it is tried after the ones there are."""
    READERS.append((kind, reader))
    if magic:
        OWN_MAGICS.append((kind, magic))


def route(content: F.Column) -> F.Column:
    """The type that decides which reader opens the content: the detected one if there is a reader for it, else the first
    registered magic, else the detected one."""
    known = detect.known_type(content)
    out = F.when(known.isin([k for k, _ in READERS]), known)
    for kind, magic in OWN_MAGICS:
        out = out.when(F.startswith(content, F.lit(magic)), kind)
    return out.otherwise(known)


def _open(readers: list, contents: bool, max_bytes: int, fail: bool):
    by_kind = {k: r for k, r in reversed(readers)}
    names = ["package", "path", "is_dir", "size", "content", "error"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, kind, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows, total = [], 0
                try:
                    if kind.as_py() not in by_kind:
                        raise FormatError(f"no reader for {kind.as_py()}")
                    for path, is_dir, size, read in by_kind[kind.as_py()](content.as_py()):
                        total += size
                        if total > max_bytes:
                            raise SecurityError(f"expands to more than {max_bytes} bytes")
                        rows.append((package.as_py(), path, is_dir, size, read() if contents and not is_dir else None, None))
                except Exception as x:
                    if fail:
                        raise
                    rows.append((package.as_py(), None, None, None, None, str(x)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def members(df: DataFrame, id_col: str, content_col: str, contents: bool = False, max_bytes: int = security.MAX_BYTES, fail: bool = False) -> DataFrame:
    """(package, path, is_dir, size, created_at, modified_at, mode, content, error) of what each row's package holds.

    Rows of a type without reader, and packages that cannot be read or expand too far, give one row with an error, or stop the
    query with fail. Times are not kept."""
    routed = df.select(F.col(id_col).cast("string").alias("package"), route(F.col(content_col)).alias("kind"), F.col(content_col).alias("content")).filter("content is not null")
    out = routed.mapInArrow(_open(list(READERS), contents, max_bytes, fail), "package string, path string, is_dir boolean, size bigint, content binary, error string")
    return out.select("package", "path", "is_dir", "size", F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("modified_at"), F.lit(FILE_MODE).alias("mode"), "content", "error")


def nested(df: DataFrame, id_col: str, content_col: str, max_depth: int = security.MAX_DEPTH) -> DataFrame:
    """(root, path, depth, kind, size, is_container, error) of each row and, level by level, of all that its packages hold.

    A package that cannot be read stays with the error. Each level is written to the shared folder, so no package is opened
    twice. A level that still holds packages below max_depth stops the query."""
    level = df.select(F.col(id_col).cast("string").alias("root"), F.lit("").alias("path"), F.col(content_col).alias("content"))
    level = level.withColumn("number", F.monotonically_increasing_id())
    parts: list[DataFrame] = []
    for depth in range(max_depth + 2):
        security.check_depth(depth, max_depth)
        seen = shared.written(level.withColumn("kind", detect.detected_type(F.col("content"))), "nested")
        inner = seen.filter(F.col("kind").isin([k for k, _ in READERS]))
        last = inner.limit(1).count() == 0
        opened = members(inner if not last else inner.limit(0), "number", "content", contents=True)
        opened = shared.written(opened.select(F.col("package").cast("long").alias("within"), "path", "is_dir", "content", "error"), "nested")
        failed = opened.filter("error is not null").select("within", "error")
        listed = seen.select("root", "path", F.lit(depth).alias("depth"), "kind", F.octet_length("content").cast("long").alias("size"), detect.is_container(F.col("kind")).alias("is_container"), "number")
        parts.append(listed.join(failed, F.col("number") == F.col("within"), "left").drop("number", "within"))
        if last:
            break
        above = seen.select(F.col("number").alias("within"), "root", F.col("path").alias("above"))
        found = opened.filter("error is null and not is_dir").join(above, "within")
        level = found.select("root", F.concat_ws("/", F.nullif("above", F.lit("")), "path").alias("path"), "content").withColumn("number", F.monotonically_increasing_id())
    return reduce(DataFrame.unionByName, parts)
