"""Codec pipelines and the choice of the smallest that decodes to its input."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from ..errors import DecodeError
from . import coders, transforms

# The methods in the order that breaks ties, the lengths that decide which take part, and the levels.
METHODS = ("Raw", "Lz77Huffman", "DeltaPredictorRange", "BwtMtfRle", "ContextPredictorRange", "CdcDeduplicated")
BWT_MOST = 1 << 20
RAW_FLOOR = 1029
LEVELS = ("Fast", "Balanced", "High", "Ultra", "Extreme", "Research")
RESEARCH_LEVELS = ("Extreme", "Research")

_BEFORE: dict[str, Callable[[bytes], bytes]] = {
    "Lz77Huffman": coders.lz_encode,
    "DeltaPredictorRange": lambda x: transforms.predict(transforms.delta(x)),
    "BwtMtfRle": lambda x: transforms.rle(transforms.bwt_mtf(x)),
    "ContextPredictorRange": transforms.predict,
}
_AFTER: dict[str, Callable[[bytes], bytes]] = {
    "Lz77Huffman": coders.lz_decode,
    "DeltaPredictorRange": lambda x: transforms.undelta(transforms.unpredict(x)),
    "BwtMtfRle": lambda x: transforms.unbwt_mtf(transforms.unrle(x)),
    "ContextPredictorRange": transforms.unpredict,
}
_RANGE = ("DeltaPredictorRange", "ContextPredictorRange")


def encode(method: str, data: bytes, lossy_head: bool = False) -> bytes:
    if method in ("Raw", "CdcDeduplicated") or not data:
        return data
    prepared = _BEFORE[method](data)
    return coders.range_encode(prepared, lossy_head) if method in _RANGE else coders.huffman_encode(prepared)


def decode(method: str, data: bytes) -> bytes:
    """Any method; unknown ones are taken for stored bytes."""
    if method not in _AFTER or not data:
        return data
    return _AFTER[method](coders.range_decode(data) if method in _RANGE else coders.huffman_decode(data))


def verified(method: str, data: bytes, coded: bytes) -> bool:
    try:
        return hashlib.sha256(decode(method, coded)).digest() == hashlib.sha256(data).digest()
    except DecodeError:
        return False


def candidates(data: bytes, research: bool = False) -> list[str]:
    """Methods that take part. Up to RAW_FLOOR bytes no other can be smaller than the bytes themselves."""
    if len(data) <= RAW_FLOOR:
        return ["Raw"]
    return [m for m in METHODS[:5] if m != "BwtMtfRle" or research or len(data) <= BWT_MOST]


def best(data: bytes, research: bool = False, lossy_head: bool = False) -> tuple[str, bytes]:
    """The smallest verified candidate, ties by METHODS.

    Huffman sizes come from byte counts and range-coder sizes are bounded from below by their model, so only a method that
    can still win is coded in full; the winner is always decoded and compared."""
    order = []
    for method in candidates(data, research):
        if method == "Raw":
            order.append((len(data), 0, method, data))
            continue
        prepared = _BEFORE[method](data)
        size = coders.range_floor(prepared) if method in _RANGE else coders.huffman_size(prepared)
        order.append((size, METHODS.index(method), method, prepared))
    won: tuple[int, int, str, bytes] | None = None
    for size, rank, method, prepared in sorted(order, key=lambda x: x[:2]):
        if won and (size, rank) > won[:2]:
            continue
        coded = prepared if method == "Raw" else coders.range_encode(prepared, lossy_head) if method in _RANGE else coders.huffman_encode(prepared)
        if (won is None or (len(coded), rank) < won[:2]) and (method == "Raw" or verified(method, data, coded)):
            won = (len(coded), rank, method, coded)
    return won[2], won[3]


def sizes(data: bytes, research: bool = False) -> list[tuple[str, int, bool]]:
    """(method, size, verified) of every candidate, all coded and decoded in full."""
    out = []
    for method in candidates(data, research):
        coded = encode(method, data)
        out.append((method, len(coded), verified(method, data, coded)))
    return out
