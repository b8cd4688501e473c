"""Byte-level BPE encoding and decoding by a rank table.

A text is split by the tokenizer's pattern; each piece is merged on its own. A segment tree over the byte positions of
the piece holds, for each position that starts a live part, the rank of joining that part with its right neighbour; every
inner node keeps the leftmost smallest rank below it. The root names the next merge, and a merge is three point updates on
live neighbours: n bytes cost O(n log n) however they merge.

Row by row and narrow: nothing is shuffled. Pieces are cached in two generations of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import common

NONE = 1 << 40
CACHED = 400_000
"""Pieces in one generation of the cache."""
CACHED_BYTES = 64
"""Longer pieces are not cached."""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by repeated merging of the leftmost pair of least rank."""
    if not piece:
        return []
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # A node holds rank * width + position, so that the least one is also the leftmost.
    width = size
    top = NONE * width
    tree = [top] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r * width + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the live part that starts at i ends, which is where the next one starts
    before = list(range(-1, n))  # start of the live part to the left

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            value = a if a < b else b
            if tree[at] == value:
                return
            tree[at] = value
            at >>= 1

    def rank(i: int) -> int:
        j = end[i]
        if j >= n:
            return top
        r = get(piece[i : end[j]])
        return top if r is None else r * width + i

    while (best := tree[1]) < top:
        i = best % width
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        put(j, top)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for one rank table and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White space as the Unicode property has it: the separators 0x1C-0x1F are none.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.find = regex.compile(pattern.replace(r"[^\s", rf"[^{space}").replace(r"\S", rf"[^{space}]").replace(r"\s", rf"[{space}]")).findall
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        if (got := self.old.get(piece)) is None:
            raw = piece.encode()
            got = np.array(merge(raw, self.ranks), "<u4").tobytes()
            if len(raw) > CACHED_BYTES:
                return got
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.young[piece] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, packed = self.young.get, self._packed
        return b"".join([get(x) or packed(x) for x in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(load_ranks(path), pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                packed = own.encode_packed(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            ids = [own.encode(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], ["id", "content"])

    return run


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row; null text is empty and gives no ids. Rows and repeated ids stay as they are; texts are read whole, and
    a merge costs the logarithm of its piece's length, so a long text without breaks is no harder than a short one."""
    return df.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` content").mapInArrow(common.lean(_encoded(path, pattern)), "id bigint, ids array<bigint>")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, content) from (id, ids); content is binary, as ids may end inside a character."""
    return df.select("id", "ids").mapInArrow(common.lean(_decoded(path, pattern)), "id bigint, content binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row's text; number of ids and digests of the ids and of the decoded bytes."""
    return df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` content").mapInArrow(common.lean(_digests(path, pattern)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _tokens(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b in common.slices(common.string_buffers(batch.column(batch.num_columns - 1))[1]):
                part = batch.slice(a, b - a)
                texts = [x.as_py() or "" for x in part.column(part.num_columns - 1)]
                packed = [own.encode_packed(x) for x in texts]
                for text, ids in zip(texts, packed, strict=True):
                    if own.decode(np.frombuffer(ids, "<u4").tolist()) != text.encode():
                        raise ValueError("a text does not decode to itself")
                size = [len(x) // 4 for x in packed]
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size, pa.int64()), ids, sha], [*part.schema.names[:-1], "n_tokens", "ids", "ids_sha256"])

    return run


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, checked by decoding them, in place of its text; all other columns stay, but for those named like
    the new ones. Null and empty texts have no ids."""
    import public_tokenizers

    added = {"n_tokens": "long", "ids": ArrayType(IntegerType()), "ids_sha256": "string"}
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", *added)]
    kept = docs.select(*others, F.col("text").alias(common.fresh("content", docs.columns)))
    return common.map_rows(kept, _tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), drop=1, **added)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
