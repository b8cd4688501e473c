"""Suffix-array dedup of repeated byte strings across a corpus.

`maximal_repeats` is the kernel: an enhanced suffix array (suffixes in order, common prefixes of neighbours) is scanned with
a stack, which visits every node of the common-prefix interval tree; a node whose occurrences differ in the byte to their
left is a maximal repeat and comes out with all its occurrences.

For a corpus the tree is cut into parts that can be built apart. Every string of LEAST bytes names an anchor in itself, the
leftmost least hash of its GRAM-byte grams, so equal strings have equal anchors at equal offsets, wherever they stand.
Consecutive strings with one anchor form a stretch.

1. Each chunk of documents sends its distinct (gram, stretch) pairs, with the first place of each, to the partition of the
   gram: equal stretches are one leaf of the tree. The partition answers for each: alone, or seen earlier, or first but with
   other stretches around the same gram.
2. Only the last sort, the ends of repeats, needs bytes: their stretches meet by gram, as suffixes that start at the anchor.
   The interval tree over them gives for each node the strings that share so many bytes to the right; within a node, places
   sorted by what stands to the left give for each place the longest left extension it shares with an earlier one. So each
   stretch learns which of its strings start earlier elsewhere.
3. A gram with more than HOT different stretches would be an unbounded group of suffixes: its strings are leaves by themselves,
   sent one by one by their own hash, and each partition answers whether they were seen earlier. A chunk that holds more than
   MANY stretches of a gram by itself sends a mark in their place, and the gram goes this way too.

What hashes decide, without a look at the bytes: that two stretches are equal (104 bits: 56 of the gram, 48 of the stretch) and
that two strings around a gram of the third kind are (64 bits). Everything else is compared byte by byte.
A pair is sent once by each chunk, however often the chunk holds it, so a gram costs its partition MANY entries a chunk at
most, of the hundred thousands that a chunk sends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 100
GRAM = 40
SPAN = LEAST - GRAM + 1
"""Grams in a string of LEAST bytes; a stretch has at most so many strings."""
CHUNK_BYTES = 8 << 20
PARTITION_ENTRIES = 500_000
HOT, MANY = 1000, 16
BITS = 56
MARK = (1 << 48) - 1
ALONE, SEEN, FIRST, FIRST_HOT = 0, 1, 2, 3
_LAST = np.iinfo(np.int64).max


# --- kernel -------------------------------------------------------------------------------------------------------------


def intervals(common_prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """Nodes (depth, low, high) of the interval tree of suffixes low..high, children before parents; common_prefix[i] is that
    of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []  # depth and low end of the open intervals
    for i, c in enumerate([*common_prefix[1:], -1], 1):
        low = i - 1
        while stack and stack[-1][0] > c:
            depth, low = stack.pop()
            yield depth, low, i - 1
        if c > 0 and (not stack or stack[-1][0] < c):
            stack.append((c, low))


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def maximal_repeats(text: bytes, least: int) -> list[tuple[int, list[int]]]:
    """(length, all places) of every maximal repeat of at least so many bytes in one text: neither extension to the left nor to
    the right keeps all places. An occurrence at the start of the text differs to the left from any other."""
    n = len(text)
    if n < 2:
        return []
    rank, width = np.frombuffer(text, np.uint8).astype(np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        order = np.lexsort((after, rank))
        step = np.concatenate([[0], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank.max() == n - 1 or width >= n:
            break
        width *= 2
    suffixes, prefix, held = order.tolist(), [0] * n, 0
    place = rank.tolist()
    for i in range(n):
        if not place[i]:
            held = 0
            continue
        j = suffixes[place[i] - 1]
        while i + held < n and j + held < n and text[i + held] == text[j + held]:
            held += 1
        prefix[place[i]] = held
        held = max(0, held - 1)
    out = []
    for depth, low, high in intervals(prefix):
        if depth >= least:
            places = suffixes[low : high + 1]
            if len({text[p - 1] if p else -1 for p in places}) > 1:
                out.append((depth, sorted(places)))
    return sorted(out)


def _earlier_left(left: list[bytes], order: list[int]) -> list[int]:
    """For each place the longest left context it shares with an earlier place; order gives the places' ranks."""
    n = len(left)
    by = sorted(range(n), key=left.__getitem__)
    between = [0] + [shared(left[by[i - 1]], left[by[i]]) for i in range(1, n)]
    best = [-1] * n
    for walk, gap in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        stack: list[list[int]] = []  # places with rising rank; with each, the least context between it and the next on top
        for i in walk:
            c = between[i + gap] if (i + gap < n) else 0
            if stack:
                stack[-1][1] = min(stack[-1][1], c)
            me = by[i]
            while stack and order[stack[-1][0]] > order[me]:
                _, low = stack.pop()
                if stack:
                    stack[-1][1] = min(stack[-1][1], low)
            if stack:
                best[me] = max(best[me], stack[-1][1])
            stack.append([me, 1 << 30])
    return best


def resolve(stretch: list[bytes], anchor: list[int], order: list[int]) -> list[int]:
    """For stretches around one or more grams, which of their LEAST-byte strings start earlier in another stretch at the same
    offset from the gram: bit j for the string at byte j. order ranks the stretches by place."""
    right = [s[a:] for s, a in zip(stretch, anchor, strict=True)]
    suffixes = sorted(range(len(right)), key=right.__getitem__)
    prefix = [0] + [shared(right[suffixes[i - 1]], right[suffixes[i]]) for i in range(1, len(suffixes))]
    masks = [0] * len(stretch)
    for depth, low, high in intervals(prefix):
        least = max(0, LEAST - depth)
        places = [p for p in suffixes[low : high + 1] if anchor[p] >= least]
        if depth < GRAM or len(places) < 2:
            continue
        if len(places) == 2:
            a, b = places if order[places[0]] < order[places[1]] else places[::-1]
            found = [(b, shared(stretch[a][: anchor[a]][::-1], stretch[b][: anchor[b]][::-1]))]
        else:
            # left-extension diversity: what the places share on the left decides how far the repeat goes for each
            found = zip(places, _earlier_left([stretch[p][: anchor[p]][::-1] for p in places], [order[p] for p in places]), strict=True)
        for p, extent in found:
            # strings that start `offset` bytes left of the gram, for offsets least..extent
            if extent >= least:
                low_bit, high_bit = anchor[p] - extent, anchor[p] - least
                masks[p] |= ((1 << (high_bit - low_bit + 1)) - 1) << low_bit
    return masks


# --- anchors ------------------------------------------------------------------------------------------------------------


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width] for every i that has one."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All stretches of the texts, in order of place: gram hash, stretch hash, first and last string, anchor.

    The gram hash is mixed again, as anchors are least hashes and would crowd the first partitions."""
    parts = []
    for a, b in common.slices(offsets, 1 << 19):
        base, end = int(offsets[a]), int(offsets[b])
        own = data[base:end]
        if len(own) < LEAST:
            continue
        edge = (offsets[a : b + 1] - base).astype(np.int64)
        prefix = common.prefix_hash(own)
        _, down = common.powers(len(own))
        m = len(own) - GRAM + 1
        gram = common.mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[:m])
        bits = np.uint64(len(own).bit_length())
        key = (gram >> bits << bits) | np.arange(m, dtype=np.uint64)
        at = (_sliding_least(key, SPAN) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        whole = np.zeros(len(own) + 1, np.int32)
        long = np.diff(edge) >= LEAST
        np.add.at(whole, edge[:-1][long], 1)
        np.add.at(whole, edge[1:][long] - LEAST + 1, -1)
        start = np.flatnonzero(np.cumsum(whole[: len(at)]) > 0)
        if not len(start):
            continue
        at = at[start]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        first = start[new]
        last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        at = at[new]
        whole_hash = common.mix64(common.span_hash(prefix, first, last + LEAST) + (at - first).astype(np.uint64))
        parts.append((common.mix64(gram[at]) >> np.uint64(64 - BITS), whole_hash >> np.uint64(16), first + base, last + base, at + base))
    none = np.zeros(0, np.int64)
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [none.astype(np.uint64), none.astype(np.uint64), none, none, none]
    return dict(zip(("gram", "whole", "first", "last", "at"), columns, strict=True))


class Chunk:
    """A chunk with its stretches and its distinct (gram, stretch) pairs, sorted, each with its first place."""

    def __init__(self, blob: bytes):
        ids, self.data, self.offsets = common.open_chunk(blob)
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        self.ids = ids
        self.doc = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        s = self.s = stretches(self.data, self.offsets)
        n = len(s["gram"])
        order = np.lexsort((np.arange(n), s["whole"], s["gram"]))
        g, w = s["gram"][order], s["whole"][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])]) if n else np.zeros(0, bool)
        self.pair = np.empty(n, np.int64)  # of each stretch
        self.pair[order] = np.cumsum(new) - 1
        self.first = order[new]  # the stretch that stands first, of each pair
        self.gram, self.whole = g[new], w[new]
        start = np.flatnonzero(np.concatenate([[True], self.gram[1:] != self.gram[:-1]])) if len(self.gram) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(self.gram)))
        self.marked = np.repeat(size > MANY, size)  # pairs that one mark stands for
        sent = ~self.marked
        sent[start] = True
        self.entry = np.flatnonzero(sent)  # pairs that are sent, or stand for their gram
        self.entry_of = np.cumsum(sent) - 1

    def codes(self, answers: pa.Table) -> np.ndarray:
        """The answer for each pair."""
        code = _joined(answers, PAIRS)
        return np.where(self.marked, FIRST_HOT, code[self.entry_of]) if len(code) else np.zeros(0, np.uint64)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return self.doc[np.searchsorted(self.offsets, place, "right") - 1]


def _pack_entries(chunk: Chunk, key: np.ndarray, second: np.ndarray, place: np.ndarray, parts: int) -> dict[int, bytes]:
    """Entries in order of key, by partition: key, second hash, document and place within the chunk."""
    edge = common.part_bounds(key, parts, BITS)
    doc = chunk.doc_of(place)
    base = int(doc.min()) if len(doc) else 0
    out = {}
    for p in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[p], edge[p + 1])
        fields = [common.pack_sorted(key[own]), common.pack_numbers(second[own]), common.pack_numbers((doc[own] - base).astype(np.uint64)), common.pack_numbers(place[own].astype(np.uint64)), base.to_bytes(8, "little", signed=True)]
        out[p] = b"".join(len(f).to_bytes(4, "little") + f for f in fields)
    return out


def _fields(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _unpack_entries(blob: bytes) -> tuple[np.ndarray, ...]:
    key, second, doc, place, base = _fields(blob)
    return common.unpack_sorted(key), common.unpack_numbers(second), common.unpack_numbers(doc).astype(np.int64) + int.from_bytes(base, "little", signed=True), common.unpack_numbers(place).astype(np.int64)


# --- steps --------------------------------------------------------------------------------------------------------------

MESSAGE = "kind int, part int, chunk bigint, body binary"
_MESSAGE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
PAIRS, ENDS, STRINGS = 0, 1, 2


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _MESSAGE.types, strict=True)], schema=_MESSAGE)


def _send(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                c = Chunk(blob.as_py())
                second = np.where(c.marked, np.uint64(MARK), c.whole)[c.entry]
                sent = _pack_entries(c, c.gram[c.entry], second, c.s["first"][c.first[c.entry]], parts)
                yield _messages([(PAIRS, p, number, b) for p, b in sent.items()])

    return run


def _seen(rows: list[tuple[int, bytes]], grams: bool) -> list[np.ndarray]:
    """For each chunk's entries: is the pair seen earlier, and if it is the first, are there other stretches of its gram?"""
    entries = [_unpack_entries(b) for _, b in rows]
    size = [len(e[0]) for e in entries]
    key, second, doc, place = (np.concatenate(x) for x in zip(*entries, strict=True))
    chunk = np.repeat(np.array([c for c, _ in rows]), size)
    out = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if len(some):
        some = some[np.lexsort((place[some], chunk[some], doc[some], second[some], key[some]))]
        k, s = key[some], second[some]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        first = new_key | np.concatenate([[True], s[1:] != s[:-1]])
        out[some[~first]] = SEEN
        if grams:
            group = np.cumsum(new_key) - 1
            kinds = np.bincount(group, first)[group]
            out[some[first & (kinds > 1)]] = FIRST
            many = np.bincount(group, s == MARK)[group] > 0
            out[some[first & (many | (kinds > HOT))]] = FIRST_HOT
    return np.split(out, np.cumsum(size)[:-1])


def _ends(rows: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each chunk's stretches, which of their strings start earlier elsewhere."""
    gram, doc, chunk, place, anchor, text, size = [], [], [], [], [], [], []
    for number, blob in rows:
        entries, anchors, ends, body = _fields(blob)
        g, _, d, p = _unpack_entries(entries)
        a, e = common.unpack_numbers(anchors).astype(np.int64), np.cumsum(common.unpack_numbers(ends)).tolist()
        size.append(len(g))
        gram.append(g)
        doc.append(d)
        place.append(p)
        chunk.append(np.full(len(g), number))
        anchor += a.tolist()
        body = zstandard.ZstdDecompressor().decompress(body) if body else b""
        text += [body[i:j] for i, j in zip([0, *e[:-1]], e, strict=True)]
    doc, chunk, place, key = (np.concatenate(x) for x in (doc, chunk, place, gram))
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((place, chunk, doc))] = np.arange(len(doc))
    masks = np.zeros(len(doc), np.uint64)
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
    # A batch of grams shares one suffix array; suffixes of different grams share less than a gram.
    at = 0
    while at < len(edge) - 1:
        end = min(max(at + 1, int(np.searchsorted(edge, edge[at] + 5000, "right")) - 1), len(edge) - 1)
        own = order[edge[at] : edge[end]].tolist()
        masks[own] = resolve([text[i] for i in own], [anchor[i] for i in own], rank[own].tolist())
        at = end
    return np.split(masks, np.cumsum(size)[:-1])


def _answer(rows: pa.Table) -> pa.Table:
    kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
    asked = sorted(zip(rows.column("chunk").to_pylist(), (x.as_py() for x in rows.column("body")), strict=True))
    answers = _ends(asked) if kind == ENDS else _seen(asked, kind == PAIRS)
    return pa.Table.from_batches([_messages([(kind, part, c, common.pack_numbers(a)) for (c, _), a in zip(asked, answers, strict=True)])])


def _joined(answers: pa.Table, kind: int) -> np.ndarray:
    """The answers of a kind, in order of partition: that of the sorted entries."""
    got = sorted((p, b.as_py()) for k, p, b in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("body"), strict=True) if k == kind)
    return np.concatenate([common.unpack_numbers(b) for _, b in got]) if got else np.zeros(0, np.uint64)


def _strings(c: Chunk, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the strings of the hot grams' stretches, in order of place, and their two hashes."""
    hot = np.sort(c.first[code == FIRST_HOT])
    first, last = c.s["first"][hot], c.s["last"][hot]
    n = last - first + 1
    place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(hot) else np.zeros(0, np.int64)
    h = np.zeros(len(place), np.uint64)
    for a, b in common.slices(c.offsets, 1 << 20):
        own = slice(*np.searchsorted(place, [c.offsets[a], c.offsets[b]]))
        if own.stop > own.start:
            at = place[own] - c.offsets[a]
            h[own] = common.span_hash(common.prefix_hash(c.data[c.offsets[a] : c.offsets[b]]), at, at + LEAST)
    return place, h >> np.uint64(64 - BITS), h & np.uint64((1 << (64 - BITS)) - 1)


def _first_strings(place: np.ndarray, key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct string the index of its first place, sorted by hash; and of each string the distinct one."""
    order = np.lexsort((place, second, key))
    k, s = key[order], second[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(order) else np.zeros(0, bool)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], own


def _send_ends(parts: int) -> Callable:
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for number, blob in zip(chunks.column("chunk").to_pylist(), chunks.column("blob"), strict=True):
            c = Chunk(blob.as_py())
            code = c.codes(answers)
            some = np.flatnonzero(code == FIRST)
            stretch = c.first[some]
            first, end, anchor = c.s["first"][stretch], c.s["last"][stretch] + LEAST, c.s["at"][stretch] - c.s["first"][stretch]
            key = c.gram[some]
            edge = common.part_bounds(key, parts, BITS)
            entries = _pack_entries(c, key, np.zeros(len(key), np.uint64), first, parts)
            for p, packed in entries.items():
                own = slice(edge[p], edge[p + 1])
                body = b"".join(c.data[i:j].tobytes() for i, j in zip(first[own].tolist(), end[own].tolist(), strict=True))
                fields = [packed, common.pack_numbers(anchor[own].astype(np.uint64)), common.pack_numbers((end - first)[own].astype(np.uint64)), zstandard.ZstdCompressor(level=1).compress(body)]
                rows.append((ENDS, p, number, b"".join(len(f).to_bytes(4, "little") + f for f in fields)))
            place, key, second = _strings(c, code)
            own, _ = _first_strings(place, key, second)
            rows += [(STRINGS, p, number, b) for p, b in _pack_entries(c, key[own], second[own], place[own], parts).items()]
        return pa.Table.from_batches([_messages(rows)])

    return run


def covered(c: Chunk, answers: pa.Table) -> np.ndarray:
    """For each byte of the chunk whether a string of LEAST bytes over it starts earlier."""
    change = np.zeros(len(c.data) + 1, np.int32)
    code = c.codes(answers)
    if len(code):
        gone = code[c.pair] == SEEN
        repeat = np.ones(len(c.pair), bool)
        repeat[c.first] = False
        gone |= repeat
        np.add.at(change, c.s["first"][gone], 1)
        np.add.at(change, c.s["last"][gone] + LEAST, -1)
        masks = _joined(answers, ENDS)
        first = c.s["first"][c.first[code == FIRST]]
        for j in range(SPAN):
            place = first[(masks >> np.uint64(j)) & np.uint64(1) > 0] + j
            np.add.at(change, place, 1)
            np.add.at(change, place + LEAST, -1)
        place, key, second = _strings(c, code)
        if len(place):
            own, distinct = _first_strings(place, key, second)
            gone = _joined(answers, STRINGS)[distinct] == SEEN
            repeat = np.ones(len(place), bool)
            repeat[own] = False
            place = place[gone | repeat]
            np.add.at(change, place, 1)
            np.add.at(change, place + LEAST, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    ids, n_bytes, n_removed, starts, lengths, sha = [], [], [], [], [], []
    for blob in chunks.column("blob"):
        c = Chunk(blob.as_py())
        gone = covered(c, answers)
        ids.append(c.ids)
        for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            n_bytes.append(b - a)
            n_removed.append(int(own.sum()))
            starts.append(turn[::2].tolist())
            lengths.append((turn[1::2] - turn[::2]).tolist())
            sha.append(hashlib.sha256(c.data[a:b][~own].tobytes()).hexdigest())
    return pa.Table.from_arrays(
        [pa.concat_arrays(ids) if ids else pa.array([], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(sha, pa.string())],
        ["id", "n_bytes", "n_removed", "starts", "lengths", "kept_sha256"],
    )


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, starts, lengths, kept_sha256) for each row: the maximal runs of bytes covered by a LEAST-byte
    string that also starts earlier, in a row with a smaller id or further left, and the digest of what is left.

    Null texts are empty; texts of any length are read whole (one text is one chunk at least). Rows without id come last; rows
    that share an id are ordered by chunk and place, so that one of them is first. An empty table gives no rows."""
    chunks = common.chunks(docs, id_col, text_col, CHUNK_BYTES, "suffix-chunks")
    n_bytes, n_chunks = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0, chunks.count()
    parts = max(1, -(-int(n_bytes) * 2 // (SPAN + 1) // PARTITION_ENTRIES))
    # Partitions are numbered and chunks dealt out by the corpus's size, not by the session's number of partitions.
    answered = lambda sent, n, number: common.grouped(sent, n, number, ["kind", "part"], _answer, MESSAGE)
    dealt = lambda df: common.dealt_out(df, n_chunks, "chunk")
    sent = chunks.mapInArrow(common.lean(_send(parts)), MESSAGE)
    pairs = common.spool(answered(sent, parts, F.col("part")), "suffix-pairs")
    more = dealt(chunks).cogroup(dealt(pairs)).applyInArrow(_send_ends(parts), MESSAGE)
    ends = common.spool(answered(more, 2 * parts, (F.col("kind") - ENDS) * parts + F.col("part")), "suffix-ends")
    schema = "id bigint, n_bytes bigint, n_removed bigint, starts array<bigint>, lengths array<bigint>, kept_sha256 string"
    return dealt(chunks).cogroup(dealt(pairs.union(ends))).applyInArrow(_cut, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
