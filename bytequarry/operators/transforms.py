"""Reversible byte transforms as functions on bytes, vectorised where the recurrence allows it. Empty gives empty."""

from __future__ import annotations

import numpy as np

from ..errors import DecodeError


def _bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def delta(data: bytes) -> bytes:
    """Differences to the previous byte modulo 256; the first byte stays."""
    return np.diff(_bytes(data), prepend=np.uint8(0)).tobytes() if data else b""


def undelta(data: bytes) -> bytes:
    return np.cumsum(_bytes(data), dtype=np.uint8).tobytes()


def rle(data: bytes) -> bytes:
    """Pairs (count, byte); runs over 255 are split."""
    if not data:
        return b""
    b = _bytes(data)
    start = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    length = np.diff(np.append(start, len(b)))
    pieces = -(-length // 255)
    count = np.full(int(pieces.sum()), 255)
    count[np.cumsum(pieces) - 1] = length - 255 * (pieces - 1)
    return np.stack([count.astype(np.uint8), np.repeat(b[start], pieces)], 1).tobytes()


def unrle(data: bytes) -> bytes:
    """Expands pairs; a count of 0 gives nothing, an odd length is an error."""
    if len(data) % 2:
        raise DecodeError("run-length stream of odd length")
    pairs = _bytes(data).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


def predict(data: bytes) -> bytes:
    """Differences to the byte that followed the same previous byte last time (0 at first)."""
    if not data:
        return b""
    b = _bytes(data)
    before = np.concatenate([np.zeros(1, np.uint8), b[:-1]])
    order = np.argsort(before, kind="stable")  # within one context in order of place
    grouped = b[order]
    last = np.concatenate([np.zeros(1, np.uint8), grouped[:-1]])
    last[np.concatenate([[True], before[order][1:] != before[order][:-1]])] = 0
    out = np.empty_like(b)
    out[order] = grouped - last
    return out.tobytes()


def unpredict(data: bytes) -> bytes:
    """The inverse is a true recurrence: each context is known only once the byte before is."""
    table, out, before = [0] * 256, bytearray(len(data)), 0
    for i, d in enumerate(data):
        value = (d + table[before]) & 255
        table[before] = value
        out[i] = value
        before = value
    return bytes(out)


def rotations(data: bytes) -> np.ndarray:
    """Starts of the cyclic rotations in order, equal ones by start: prefix doubling of those that are not yet alone.

    A rank is the number of rotations known to be smaller; group, rank and start share 63 bits, else groups are sorted in two steps."""
    n, width = len(data), 4
    if not n:
        return np.zeros(0, np.int64)
    place = n.bit_length()
    b = np.resize(_bytes(data), n + width).astype(np.int64)
    key = b[:n] << 24 | b[1 : n + 1] << 16 | b[2 : n + 2] << 8 | b[3 : n + 3]
    at, rank, order = np.arange(n), np.zeros(n, np.int64), np.empty(n, np.int64)
    first = np.zeros(n, np.int64)  # of each one's group
    while True:
        if 3 * place <= 63 or width == 4 and 32 + place <= 63:
            if width > 4:
                key = first << place | key
            both = np.sort(key << place | at)
            by, key = both & ((1 << place) - 1), both >> place
            first = first if width == 4 else np.sort(first)
        else:
            step = np.lexsort((at, key, first))
            by, key, first = at[step], key[step], first[step]
            key = key + first * (n + 1) if width > 4 else key
        other = np.concatenate([[True], key[1:] != key[:-1]])
        # A group's place is that of its parent, and its own within it.
        here = np.arange(len(by))
        head = np.concatenate([[True], first[1:] != first[:-1]])
        slot = first + here - np.maximum.accumulate(np.where(head, here, 0))
        first = slot[np.maximum.accumulate(np.where(other, here, 0))]
        order[slot] = by
        rank[by] = first
        alone = other & np.append(other[1:], True)
        if width >= n or alone.all():
            return order
        at, first = by[~alone], first[~alone]
        key = rank[(at + width) % n]
        width *= 2


def bwt(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted rotations and the row of the text itself."""
    if not data:
        return b"", 0
    order = rotations(data)
    return _bytes(data)[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def unbwt(column: bytes, row: int) -> bytes:
    n = len(column)
    if not n:
        return b""
    if row >= n:
        raise DecodeError("row index beyond the transformed bytes")
    b = _bytes(column)
    following = np.argsort(b, kind="stable")
    rows = following[[row]]
    while len(rows) < n:  # all rows so far, and as many steps on
        rows = np.concatenate([rows, following[rows]])
        following = following[following] if len(rows) < n else following
    return b[rows[:n]].tobytes()


def mtf(data: bytes) -> bytes:
    """Places of the bytes in a list that moves each to the front, 0..255 at first. A repeated byte is at the front."""
    if not data:
        return b""
    b = _bytes(data)
    heads = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    table, out, places = bytearray(range(256)), np.zeros(len(b), np.uint8), []
    find, add = table.index, places.append
    for x in b[heads].tobytes():
        at = find(x)
        if at:
            del table[at]
            table.insert(0, x)
        add(at)
    out[heads] = places
    return out.tobytes()


def unmtf(data: bytes) -> bytes:
    """Place 0 repeats the byte before."""
    if not data:
        return b""
    places = _bytes(data)
    heads = np.flatnonzero(places)
    table, out = bytearray(range(256)), bytearray(1)
    for at in places[heads].tobytes():
        x = table.pop(at)
        table.insert(0, x)
        out.append(x)
    return np.repeat(_bytes(bytes(out)), np.diff(np.concatenate([[0], heads, [len(places)]]))).tobytes()


def bwt_mtf(data: bytes) -> bytes:
    """Row index, four bytes big-endian, then the moved-to-front last column."""
    if not data:
        return b""
    column, row = bwt(data)
    return row.to_bytes(4, "big") + mtf(column)


def unbwt_mtf(data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) < 4:
        raise DecodeError("transformed block shorter than its row index")
    return unbwt(unmtf(data[4:]), int.from_bytes(data[:4], "big"))
