"""What the operators of this subpackage share: table access, spooling to the cluster's shared folder, and a
vectorised word splitter over Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
"""Texts are worked on in slices of about this many bytes, so that a worker's memory does not depend on the batch size."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach: spark.checkpoint.dir, else (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bytequarry-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete_on_exit(spark: SparkSession, path: str) -> None:
    system, hadoop = _file_system(spark, path)
    system.deleteOnExit(hadoop)


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop)


def drop_spooled(df: DataFrame) -> None:
    """Deletes a spooled table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        system, hadoop = _file_system(spark, file)
        system.delete(hadoop.getParent(), True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever the case of letters."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about limit bytes each, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not glibc: there is nothing to trim
        return None


def release() -> None:
    """Gives freed memory back to the system: workers live on after a stage and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that releases memory after each batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            release()
        release()

    return wrapped


def map_rows(df: DataFrame, run: Callable, drop: int = 0, **added: str) -> DataFrame:
    """df.mapInArrow(run) for columns of any name: run sees them by place, leaves out the last few and adds the named ones."""
    names = df.columns[: len(df.columns) - drop]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    schema = StructType(plain.schema.fields[: len(names)])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return plain.mapInArrow(lean(run), schema).toDF(*names, *added)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64 and of its inverse; kept for the worker's life."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(n + 1, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums c of a polynomial hash; the hash of data[a:b] is (c[b] - c[a]) * inverse power a."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix) - 1)
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a run of texts: byte spans in data, 64-bit hashes, and for text i the words first[i]..first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are no separators (by default space and 0x09-0x0D), A-Z lower-cased, never across texts."""
    base, data = int(offsets[0]), data[int(offsets[0]) : int(offsets[-1])]
    edge = (offsets - base).astype(np.int64)
    data = _LOWER[data] if lower else data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64))
    space = separators[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = edge[1:-1][(edge[1:-1] > 0) & (edge[1:-1] < len(data))]
    begins[inner] = ~space[inner]
    ends[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, span_hash(prefix_hash(data), start, end), np.searchsorted(start, edge))


def split_sliced(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, limit: int = 1 << 20) -> Words:
    """split_words a slice at a time, so that hashing many texts needs little memory."""
    parts, at, n = [], 0, 0
    for a, b in slices(offsets, limit):
        w = split_words(data, offsets[a : b + 1], separators=separators)
        parts.append((w.data, w.start + at, w.end + at, w.hash, w.first[:-1] + n))
        at += len(w.data)
        n += len(w.start)
    if not parts:
        return split_words(data, offsets, separators=separators)
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return Words(*joined[:4], np.append(joined[4], n))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(words[j : j + m] + np.uint64(j + 1))
    return mix64(out)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes of the least width, compressed."""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(b), dtype=np.uint64)


def part_bounds(sorted_hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of so many equal ranges of bits-wide hashes begins, and the end."""
    inner = np.searchsorted(sorted_hashes, np.array([(p << bits) // parts for p in range(1, parts)], np.uint64))
    return np.concatenate([[0], inner, [len(sorted_hashes)]])


def _pack_chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, serial = TaskContext.get().partitionId(), [], 0, 0

        def out() -> pa.RecordBatch:
            one = pa.Table.from_batches(held)
            one = one.take(pa.compute.sort_indices(one.column(0), null_placement="at_end")).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as writer:
                writer.write_table(one)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | serial], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            offsets = string_buffers(batch.column(1))[1]
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[at] + max(1, limit - size), "right")) - 1
                end = min(max(end, at + (not held)), batch.num_rows)
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(offsets[end] - offsets[at])
                    at = end
                if at < batch.num_rows or size >= limit:
                    yield out()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield out()

    return run


def chunks(df: DataFrame, id_col: str, text_col: str, limit: int, tag: str) -> DataFrame:
    """(chunk, blob): the rows in compressed chunks of about limit bytes of text, by id within a chunk (null last), spooled."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("content"))
    return spool(rows.mapInArrow(lean(_pack_chunks(limit)), "chunk bigint, blob binary"), tag)


TASKS = 100_000
"""Tasks of a step that the corpus's size numbers, at most; beyond it a task takes several groups, one after the other."""


def grouped(df: DataFrame, groups: int, number: F.Column, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run applied to each group of rows with equal keys. number, from 0 to groups - 1, deals each group to a task of its own
    (up to TASKS), so that tasks do not grow with the corpus whatever the session's number of partitions."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [i for i in range(len(of)) if not i or of[i] != of[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
                if held and of[a] != now:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                now = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    tasks = max(1, min(groups, TASKS))
    dealt = df.repartitionById(tasks, F.pmod(number.cast("long"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions(*keys).mapInArrow(lean(mapped), schema)


def dealt_out(df: DataFrame, groups: int, key: str):
    """df grouped by key for a cogroup, over twice as many tasks as there are groups (up to TASKS)."""
    return df.repartition(max(1, min(2 * groups, TASKS)), key).groupBy(key)


def open_chunk(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a chunk."""
    one = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()
    ids = one.column(0)
    ids = ids.chunk(0) if ids.num_chunks else pa.array([], pa.int64())
    return ids, *string_buffers(one.column(1))
