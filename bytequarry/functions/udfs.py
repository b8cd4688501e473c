"""Arrow-batched functions for what is truly sequential, and the library's SQL names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import coders, transforms

CODED: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "delta": (transforms.delta, transforms.undelta),
    "rle": (transforms.rle, transforms.unrle),
    "predict": (transforms.predict, transforms.unpredict),
    "bwt_mtf": (transforms.bwt_mtf, transforms.unbwt_mtf),
    "mtf": (transforms.mtf, transforms.unmtf),
    "lz77": (coders.lz_encode, coders.lz_decode),
    "huffman": (coders.huffman_encode, coders.huffman_decode),
    "range": (coders.range_encode, coders.range_decode),
}
"""Forward and inverse by name; users may add their own pairs before `register`."""


def bytes_udf(f: Callable[[bytes], bytes], kind: str = "binary"):
    """A function on bytes as a column function; null gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else f(bytes(x)) for x in s], index=s.index, dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def forward(name: str, content: Column) -> Column:
    return bytes_udf(CODED[name][0])(content)


def inverse(name: str, content: Column) -> Column:
    return bytes_udf(CODED[name][1])(content)


def _xxh64(s: pd.Series) -> pd.Series:
    signed = [None if x is None else (h := xxhash.xxh64_intdigest(bytes(x))) - ((h >> 63) << 64) for x in s]
    return pd.Series(signed, dtype="Int64")


def xxh64(content: Column) -> Column:
    """XXH64 with seed 0 as a signed 64-bit number (Spark's own xxhash64 has seed 42)."""
    return F.pandas_udf(_xxh64, "bigint")(content)


TOKENS = T.ArrayType(T.StructType([T.StructField("is_match", T.BooleanType()), T.StructField("literal", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("length", T.IntegerType())]))


TOKEN_BYTES = 1 << 20
"""Bytes of content after which the tokens so far are handed on."""


def _token_lists(contents: list[bytes | None]) -> pa.Array:
    """Lists of tokens built from columns of numbers, as a Python object for each token would not fit a worker's memory."""
    ends, columns = [0], []
    for content in contents:
        start, distance, length = (np.array(x, np.int32) for x in coders.lz_parse(content or b""))
        literal = np.frombuffer(content or b"", np.uint8)[start].astype(np.int32)
        columns.append((distance > 0, literal, distance, length))
        ends.append(ends[-1] + len(start))
    match, literal, distance, length = (np.concatenate(x) for x in zip(*columns, strict=True))
    fields = [pa.array(match), pa.array(literal, mask=match), pa.array(distance, mask=~match), pa.array(length, mask=~match)]
    gone = [None if content is None else end for content, end in zip(contents, ends, strict=False)]
    return pa.ListArray.from_arrays(pa.array([*gone, ends[-1]], pa.int32()), pa.StructArray.from_arrays(fields, TOKENS.elementType.names))


def _tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        held, size = [], 0
        for x in batch:
            held.append(x.as_py())
            size += len(held[-1] or b"")
            if size >= TOKEN_BYTES:
                yield _token_lists(held)
                held, size = [], 0
        if held:
            yield _token_lists(held)


def lz_tokens(content: Column) -> Column:
    return F.arrow_udf(_tokens, TOKENS)(content)


CHUNKS = "array<struct<offset:bigint,length:bigint>>"


def _chunks(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"offset": a, "length": n} for a, n in coders.cdc_chunks(bytes(x))] for x in s], dtype="object")


def cdc_chunks(content: Column) -> Column:
    """Content-defined chunks as an array of (offset, length)."""
    return F.pandas_udf(_chunks, CHUNKS)(content)


class _ChunkRows:
    """UDTF: one row for each content-defined chunk."""

    def eval(self, content: bytes):
        for offset, length in coders.cdc_chunks(bytes(content or b"")):
            yield offset, length


def register(spark: SparkSession) -> None:
    """SQL functions byte_<name> and byte_un<name> for every pair, byte_xxh64, byte_cdc, byte_entropy, and the table function
    cdc_rows(content)."""
    from .detect import _entropy

    for name, (there, back) in CODED.items():
        spark.udf.register(f"byte_{name}", bytes_udf(there))
        spark.udf.register(f"byte_un{name}", bytes_udf(back))
    spark.udf.register("byte_xxh64", F.pandas_udf(_xxh64, "bigint"))
    spark.udf.register("byte_cdc", F.pandas_udf(_chunks, CHUNKS))
    spark.udf.register("byte_entropy", F.pandas_udf(_entropy, "double"))
    spark.udtf.register("cdc_rows", F.udtf(_ChunkRows, returnType="offset bigint, length bigint"))
