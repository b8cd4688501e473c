"""Coders as functions on bytes: LZ77 tokens, Huffman, a static range coder, and content-defined chunks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from ..errors import DecodeError

# Fixed values of the formats.
WINDOW, SHORTEST, LONGEST = 32768, 3, 258
TABLE = 4 + 4 * 256
RANGE_TOTAL, RANGE_LOW = 65535, 1 << 24
CHUNK_LEAST, CHUNK_AVERAGE, CHUNK_MOST = 4096, 16384, 65536

PEEK, STEP = 16, 1 << 16
"""Bits that the Huffman decoder looks up at once, and bytes that it and the encoder work on at a time."""


# --- LZ77 ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Token:
    """A literal byte (distance 0) or a copy of length bytes from distance back."""

    literal: int = 0
    distance: int = 0
    length: int = 0


PROBED = 16
"""Up to this length the longest match of each position is known before parsing starts."""
SEGMENT = 1 << 20
"""Bytes whose matches are looked up at once."""


def _longest(data: bytes, start: int, stop: int) -> tuple[list[int], list[int]]:
    """For each position from start to stop the length of its longest match in the window, PROBED at most (0: none), and how far
    back the nearest such match begins.

    Positions are sorted by their next bytes, one byte more each time; those without an equal neighbour in the window drop out."""
    low = max(0, start - WINDOW)
    b = np.frombuffer(data, np.uint8)[low : stop + PROBED].astype(np.int64)
    n = len(b)
    length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = n.bit_length()
    at, key = np.arange(max(0, n - 2)), b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    for size in range(SHORTEST, PROBED + 1):
        both = np.sort(key << place | at)
        at, key = both & ((1 << place) - 1), both >> place
        other, back = key[1:] != key[:-1], at[1:] - at[:-1]
        near = np.flatnonzero(~other & (back <= WINDOW))
        if not len(near):
            break
        length[at[near + 1]] = size
        distance[at[near + 1]] = back[near]
        keep = np.zeros(len(at), bool)
        keep[near] = keep[near + 1] = True
        keep &= at + size < n
        at, group = at[keep], np.concatenate([[0], np.cumsum(other)])[keep]
        key = group << 8 | b[at + size]
    own = slice(start - low, stop - low)
    return length[own].tolist(), distance[own].tolist()


def lz_parse(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """Start, distance and length (0, 0: a literal) of the tokens of greedy parsing: the longest earlier match in the window, the
    nearest among the longest; copies may overlap themselves. What is longer than PROBED is searched for from the nearest match
    of that length on."""
    starts, distances, lengths = [], [], []
    at, n, find = 0, len(data), data.rfind
    for first in range(0, n, SEGMENT):
        stop = min(n, first + SEGMENT)
        if at >= stop:
            continue
        known, backs = _longest(data, first, stop)
        while at < stop:
            length = known[at - first]
            starts.append(at)
            if not length:
                distances.append(0)
                lengths.append(0)
                at += 1
                continue
            back = backs[at - first]
            if length == PROBED:
                source, low, most = at - back, max(0, at - WINDOW), min(n - at, LONGEST)
                while True:
                    while length < most and data[source + length] == data[at + length]:
                        length += 1
                    if length >= most:
                        break
                    found = find(data[at : at + length + 1], low, source + length)
                    if found < 0:
                        break
                    source, length = found, length + 1
                back = at - source
            distances.append(back)
            lengths.append(length)
            at += length
    return starts, distances, lengths


def lz_tokens(data: bytes) -> list[tuple[int, int, int]]:
    """(literal, distance, length) of each token."""
    return [(0, d, n) if d else (data[at], 0, 0) for at, d, n in zip(*lz_parse(data), strict=True)]


def lz_pack(tokens: list[tuple[int, int, int]]) -> bytes:
    """Literal: 0, byte. Copy: 1, distance and length, two bytes each, big-endian."""
    return b"".join([b"\1" + d.to_bytes(2, "big") + n.to_bytes(2, "big") if d else bytes((0, b)) for b, d, n in tokens])


def lz_unpack(data: bytes) -> list[tuple[int, int, int]]:
    out, at, n = [], 0, len(data)
    while at < n:
        kind = data[at]
        size = {0: 2, 1: 5}.get(kind)
        if size is None:
            raise DecodeError(f"token tag {kind}")
        if at + size > n:
            raise DecodeError("token stream ends within a token")
        if kind:
            out.append((0, int.from_bytes(data[at + 1 : at + 3], "big"), int.from_bytes(data[at + 3 : at + 5], "big")))
        else:
            out.append((data[at + 1], 0, 0))
        at += size
        if kind and not out[-1][1]:
            raise DecodeError("copy from distance 0")
    return out


def lz_expand(tokens: list[tuple[int, int, int]]) -> bytes:
    out = bytearray()
    for literal, distance, length in tokens:
        if not distance:
            out.append(literal)
            continue
        if distance > len(out):
            raise DecodeError("copy from before the start")
        start = len(out) - distance
        if length <= distance:
            out += out[start : start + length]
        else:
            period = bytes(out[start:])
            out += (period * (length // distance + 1))[:length]
    return bytes(out)


def lz_encode(data: bytes) -> bytes:
    """The packed tokens, all at once."""
    start, distance, length = (np.array(x, np.int64) for x in lz_parse(data))
    copy = distance > 0
    end = np.cumsum(np.where(copy, 5, 2))
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end[~copy] - 1] = np.frombuffer(data, np.uint8)[start[~copy]]
    for place, value in ((5, 1), (4, distance[copy] >> 8), (3, distance[copy] & 255), (2, length[copy] >> 8), (1, length[copy] & 255)):
        out[end[copy] - place] = value
    return out.tobytes()


def lz_decode(data: bytes) -> bytes:
    return lz_expand(lz_unpack(data))


# --- Huffman ------------------------------------------------------------------------------------------------------------


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def huffman_bits(counts: np.ndarray) -> int:
    """Payload bits: the sum of all merged weights, which no order of ties changes."""
    heap = sorted(int(c) for c in counts if c)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def huffman_size(data: bytes) -> int:
    if not data:
        return 0
    counts = histogram(data)
    return 5 if np.count_nonzero(counts) == 1 else TABLE + (huffman_bits(counts) + 7) // 8


def _codes(counts: list[int]) -> dict[int, str]:
    """Bit strings by symbol. Ties: the symbol or tree that was made first."""
    heap: list = [(c, s, s) for s, c in enumerate(counts) if c]
    heapq.heapify(heap)
    made = 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, made, (left, right)))
        made += 1
    codes, open_ = {}, [(heap[0][2], "")] if heap else []
    while open_:
        node, bits = open_.pop()
        if isinstance(node, tuple):
            open_ += [(node[0], bits + "0"), (node[1], bits + "1")]
        else:
            codes[node] = bits or "0"
    return codes


def huffman_encode(data: bytes) -> bytes:
    """Length, 256 counts (four bytes each, big-endian), bits from the high end; one distinct byte: length, byte."""
    if not data:
        return b""
    counts = histogram(data)
    head = len(data).to_bytes(4, "big")
    if np.count_nonzero(counts) == 1:
        return head + data[:1]
    codes = _codes(counts.tolist())
    longest = max(map(len, codes.values()))
    bits, size = np.zeros((256, longest), np.uint8), np.zeros(256, np.int64)
    for s, code in codes.items():
        size[s] = len(code)
        bits[s, : len(code)] = np.frombuffer(code.encode(), np.uint8) - 48
    b, used = np.frombuffer(data, np.uint8), np.arange(longest) < size[:, None]
    parts, rest = [head, counts.astype(">u4").tobytes()], np.zeros(0, np.uint8)
    for at in range(0, len(b), STEP):
        own = b[at : at + STEP]
        stream = np.concatenate([rest, bits[own][used[own]]])
        whole = len(stream) // 8 * 8
        parts.append(np.packbits(stream[:whole]).tobytes())
        rest = stream[whole:]
    return b"".join([*parts, np.packbits(rest).tobytes()])


def huffman_decode(data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) < 5:
        raise DecodeError("Huffman stream shorter than its head")
    n = int.from_bytes(data[:4], "big")
    if not n:
        return b""
    if len(data) == 5:
        return data[4:] * n
    if len(data) < TABLE:
        raise DecodeError("Huffman table truncated")
    codes = _codes(np.frombuffer(data[4:TABLE], ">u4").tolist())
    if not codes:
        raise DecodeError("Huffman table without symbols")
    if (len(data) - TABLE) * 8 < n * min(map(len, codes.values())):
        raise DecodeError("Huffman bits end early")
    symbol, length, long = np.zeros(1 << PEEK, np.uint8), np.zeros(1 << PEEK, np.uint8), {}
    for s, code in codes.items():
        if len(code) <= PEEK:
            low, spread = int(code, 2) << (PEEK - len(code)), 1 << (PEEK - len(code))
            symbol[low : low + spread], length[low : low + spread] = s, len(code)
        else:
            long[code] = s
    payload = np.frombuffer(data, np.uint8)[TABLE:]
    ends = len(payload) * 8
    out, at, left = [], 0, n
    while left:
        base = at // 8
        own = np.zeros(min(STEP, len(payload) - base) + 2, np.uint32)
        own[: min(len(own), len(payload) - base)] = payload[base : base + len(own)]
        three = own[:-2] << 16 | own[1:-1] << 8 | own[2:]
        peek = (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).ravel()
        steps = length[peek]
        places, here = _orbit(steps, at - base * 8, left)
        limit = len(steps)
        out.append(symbol[peek[places]].tobytes())
        left -= len(places)
        if left:
            at = base * 8 + here
            if here < limit:  # a code longer than what was peeked at, or none
                s, at = _long_symbol(payload, at, long)
                out.append(bytes([s]))
                left -= 1
            if left and at >= ends:
                raise DecodeError("Huffman bits end early")
        else:
            last = int(places[-1])
            at = base * 8 + last + int(steps[last])
    if at > ends:
        raise DecodeError("Huffman bits end early")
    return b"".join(out)


def _orbit(steps: np.ndarray, at: int, most: int) -> tuple[np.ndarray, int]:
    """The places from at on, each a step after the one before, that lie within steps and have a step, most at most; and where the
    next would be. Four steps (of PEEK at most) are taken at once; the places between follow by halves."""
    end = len(steps)
    after, powers = np.arange(end), [np.concatenate([steps, np.zeros(4 * PEEK, np.uint8)])]
    for _ in range(2):  # a place without a step stays
        one = powers[-1]
        both = np.zeros_like(one)
        both[:end] = one[:end] + one[after + one[:end]]
        powers.append(both)
    leap, marks, here = powers.pop().tobytes(), [], at
    add = marks.append
    while here < end and (step := leap[here]) and 4 * len(marks) < most:
        add(here)
        here += step
    places = np.array(marks, np.int64)
    for power in reversed(powers):
        places = np.stack([places, places + power[places]], 1).ravel()
    places = places[powers[0][places] > 0][:most]
    return places, int(places[-1]) + int(steps[places[-1]]) if len(places) else at


def _long_symbol(payload: np.ndarray, at: int, codes: dict[str, int]) -> tuple[int, int]:
    """The symbol whose code of more than PEEK bits starts at a bit, and where it ends."""
    most = max(map(len, codes), default=0)
    bits = "".join(map(str, np.unpackbits(payload[at // 8 : (at + most) // 8 + 1])[at % 8 :][:most].tolist()))
    for end in range(PEEK + 1, len(bits) + 1):
        if bits[:end] in codes:
            return codes[bits[:end]], at + end
    raise DecodeError("Huffman bits end early")


# --- Range coder --------------------------------------------------------------------------------------------------------


def range_weights(data: bytes) -> list[int]:
    """Static model: counts scaled to about RANGE_TOTAL, 1 at least for each byte that occurs."""
    counts = histogram(data)
    return [max(1, int(c) * RANGE_TOTAL // len(data)) if c else 0 for c in counts]


def range_floor(data: bytes) -> int:
    """A size that the range coder cannot go below: the ideal code length under its model, in whole bytes."""
    if not data:
        return TABLE
    counts, weights = histogram(data), np.array(range_weights(data), np.float64)
    used = counts > 0
    bits = float((counts[used] * np.log2(weights.sum() / weights[used])).sum())
    return TABLE + max(0, int(bits / 8) - 4)


def range_encode(data: bytes, lossy_head: bool = False) -> bytes:
    """Length and 256 weights (four bytes each, big-endian), then the code bytes; carries run back through bytes written.

    lossy_head drops leading 0xFF code bytes, as another encoder of this format does; such a stream does not decode."""
    head = len(data).to_bytes(4, "big")
    if not data:
        return head + bytes(TABLE - 4)
    weights = range_weights(data)
    below = [0]
    for w in weights:
        below.append(below[-1] + w)
    total, low, span, out, full = below[-1], 0, 0xFFFFFFFF, bytearray(), -1
    for b in data:
        unit = span // total
        low += unit * below[b]
        span = unit * weights[b] or 1
        while span < RANGE_LOW:
            top = low >> 24
            if full < 0 and top != 0xFF:
                full = len(out)  # code bytes before the first that is not 0xFF
            if top > 0xFF:
                _carry(out)
                top &= 0xFF
            out.append(top)
            low = (low & 0xFFFFFF) << 8
            span <<= 8
    lead = len(out) if full < 0 else full
    if low >> 32:
        _carry(out)
    out += (low & 0xFFFFFFFF).to_bytes(4, "big")
    return head + np.array(weights, ">u4").tobytes() + bytes(out[lead:] if lossy_head else out)


def _carry(out: bytearray) -> None:
    i = len(out) - 1
    while i >= 0 and out[i] == 0xFF:
        out[i] = 0
        i -= 1
    if i >= 0:
        out[i] += 1


def range_decode(data: bytes) -> bytes:
    """Bytes beyond the end count as 0; a table without weights gives nothing."""
    if len(data) < TABLE:
        raise DecodeError("range coder's head truncated")
    n = int.from_bytes(data[:4], "big")
    weights = np.frombuffer(data[4:TABLE], ">u4").tolist()
    total = sum(weights)
    if not n or not total:
        return b""
    if total > RANGE_LOW:
        raise DecodeError("range coder's weights are too large")
    below, symbol = [0], []
    for s, w in enumerate(weights):
        below.append(below[-1] + w)
        symbol += [s] * w
    code, at = int.from_bytes(data[TABLE : TABLE + 4].ljust(4, b"\0"), "big"), TABLE + 4
    low, span, out, end = 0, 0xFFFFFFFF, bytearray(n), len(data)
    for i in range(n):
        unit = span // total
        place = ((code - low) & 0xFFFFFFFF) // unit
        s = symbol[place] if place < total else 255
        low = (low + unit * below[s]) & 0xFFFFFFFF
        span = unit * weights[s] or 1
        while span < RANGE_LOW:
            code = (code << 8 & 0xFFFFFFFF) | (data[at] if at < end else 0)
            at += 1
            low = low << 8 & 0xFFFFFFFF
            span <<= 8
        out[i] = s
    return bytes(out)


# --- Content-defined chunks ---------------------------------------------------------------------------------------------


def cdc_chunks(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of content-defined chunks.

    A chunk ends after the byte where h = 2 h + b * odd, started afresh CHUNK_LEAST bytes into the chunk, is 0 modulo
    CHUNK_AVERAGE, or at CHUNK_MOST bytes. Modulo 2**14 only the last 14 bytes count and the odd factor drops out, so the sums
    for full windows are one convolution, shared by all chunks; the first 13 places of a chunk have partial ones."""
    n, out, start = len(data), [], 0
    if not n:
        return out
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    bits = CHUNK_AVERAGE.bit_length() - 1
    full = np.zeros(n, np.int64)
    for j in range(min(bits, n)):
        full[j:] += b[: n - j] << j
    cuts = np.flatnonzero(full % CHUNK_AVERAGE == 0)
    while start < n:
        first, stop = start + CHUNK_LEAST, min(start + CHUNK_MOST, n)
        end, h = stop, 0
        if first < n:
            for p in range(first, min(first + bits - 1, stop)):
                h = 2 * h + int(b[p])
                if h % CHUNK_AVERAGE == 0:
                    end = p + 1
                    break
            else:
                at = int(np.searchsorted(cuts, first + bits - 1))
                if at < len(cuts) and cuts[at] < stop:
                    end = int(cuts[at]) + 1
        out.append((start, end - start))
        start = end
    return out
