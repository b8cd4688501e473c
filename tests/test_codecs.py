"""Transforms, coders and pipelines as functions on bytes."""

import math
import os
import random
import time
import tracemalloc
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.errors import DecodeError
from bytequarry.functions import udfs
from bytequarry.functions.udfs import CODED
from bytequarry.operators import coders, tournament, transforms

LOG = b"2026-01-01 10:00:00 INFO user=alice action=login ok\n2026-01-01 10:00:01 WARN user=bob action=login denied\n"
EDGES = [
    b"", b"\0", b"a", b"ab" * 600, b"a" * 254, b"a" * 255, b"a" * 256, b"a" * 1029, b"a" * 1030, bytes(range(256)) * 4, LOG * 20,
    b"\xff\xd8\xff\xe0" + bytes(range(200)) * 8, b"\xff" * 1500, "naïve ☃ text ".encode() * 100, bytes(10) + b"\xff" * 10,
]


@pytest.mark.parametrize("name", CODED)
@pytest.mark.parametrize("data", EDGES)
def test_inverse_of_forward_is_identity(name, data):
    there, back = CODED[name]
    assert back(there(data)) == data


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_any_bytes_come_back(data):
    for there, back in CODED.values():
        assert back(there(data)) == data


def test_known_values():
    assert transforms.delta(bytes([10, 12, 15, 20, 25, 20, 10])) == bytes([10, 2, 3, 5, 5, 251, 246])
    assert transforms.rle(b"AAAAABBBCCCDDDDDDD") == b"\x05A\x03B\x03C\x07D"
    assert transforms.rle(b"a" * 256) == b"\xffa\x01a"
    assert transforms.unrle(b"\0x\2y") == b"yy"
    assert transforms.bwt(b"banana") == (b"nnbaaa", 3)
    assert transforms.mtf(b"aab") == bytes([97, 0, 98])
    assert coders.huffman_encode(b"zzz") == b"\0\0\0\3z"
    assert coders.range_encode(b"") == bytes(1028)
    assert coders.lz_encode(b"abcabcabc") == b"\0a\0b\0c\1\0\3\0\6"


def _slow_lz(d):
    out, p = [], 0
    while p < len(d):
        best = (0, 0)
        for back in range(1, min(p, coders.WINDOW) + 1):
            n = 0
            while n < min(len(d) - p, coders.LONGEST) and d[p - back + n] == d[p + n]:
                n += 1
            if n > best[0]:
                best = (n, back)
        if best[0] >= coders.SHORTEST:
            out.append((0, best[1], best[0]))
            p += best[0]
        else:
            out.append((d[p], 0, 0))
            p += 1
    return out


def test_matches_are_the_longest_and_nearest():
    rnd = random.Random(5)
    for _ in range(60):
        d = bytes(rnd.randrange(rnd.choice([2, 4, 200])) for _ in range(rnd.randrange(300)))
        assert coders.lz_tokens(d) == _slow_lz(d)


def test_matches_beyond_a_segment_and_beyond_what_is_probed(monkeypatch):
    rnd = random.Random(8)
    line = bytes(rnd.choices(b"abcdef ", k=400))
    parts = (line[rnd.randrange(200) :][: rnd.randrange(1, 300)] for _ in range(12))
    for d in (b"".join(p + bytes(rnd.choices(b"xyz", k=3)) for p in parts), b"ab" * 900, line + line):
        want = _slow_lz(d)
        for size in (1, 100, 1 << 20):
            monkeypatch.setattr(coders, "SEGMENT", size)
            assert coders.lz_tokens(d) == want
            assert coders.lz_encode(d) == coders.lz_pack(want)


def test_tokens_take_little_memory():
    """As columns of numbers, handed on after every TOKEN_BYTES of content, not as objects of a whole batch."""
    rnd = random.Random(9)
    texts = [bytes(rnd.choices(b"abcdefghijklmnop \n", k=udfs.TOKEN_BYTES // 4)) for _ in range(8)] + [b"", None, b"a"]
    tracemalloc.start()
    sizes = []
    for x in udfs._tokens(iter([pa.array(texts, pa.binary())])):
        sizes += [None if n is None else n.as_py() for n in pc.list_value_length(x)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * udfs.TOKEN_BYTES
    assert sizes == [len(coders.lz_parse(t)[0]) if t is not None else None for t in texts]


@pytest.mark.parametrize("data", [b"ab" * 700, b"a" * 999, b"abcab" * 50 + b"c", bytes(range(256)) * 3, LOG * 9, b"x" + LOG * 2 + b"x", b"aab", b"ba", b"z"])
def test_rotations_in_order_and_equal_ones_by_start(data):
    assert transforms.rotations(data).tolist() == sorted(range(len(data)), key=lambda i: (data[i:] + data[:i], i))


def test_best_of_a_solid_block_takes_little_time():
    """Less time than plain loops over the bytes: against a yardstick of such loops on the same machine."""
    rnd = random.Random(11)
    words = [bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 9))) for _ in range(900)]
    block = b" ".join(rnd.choice(words) for _ in range(11000))[: 1 << 16]
    tournament.best(block[:5000])

    def seconds(f):
        start = time.thread_time()
        f()
        return time.thread_time() - start

    yardstick = min(seconds(lambda: transforms.unpredict(block)) for _ in range(5))
    assert min(seconds(lambda: tournament.best(block)) for _ in range(3)) < 16 * yardstick


def test_window_edge():
    gap = bytes(random.Random(1).choices(range(128, 256), k=coders.WINDOW - 7))
    near, far = b"needle!" + gap + b"needle!", b"needle!" + gap + b"\x80" + b"needle!"
    assert coders.lz_tokens(near)[-1] == (0, coders.WINDOW, 7)
    assert (0, coders.WINDOW + 1, 7) not in coders.lz_tokens(far)
    assert coders.lz_decode(coders.lz_encode(far)) == far


@pytest.mark.parametrize("stream", [b"\0", b"\1\0\1\0", b"\2x", b"\1\0\5\0\1", b"\0a\1\0\0\0\3"])
def test_bad_tokens_are_refused(stream):
    with pytest.raises(DecodeError):
        coders.lz_decode(stream)


def test_truncated_streams_are_refused():
    for broken in (coders.huffman_encode(LOG)[:900], coders.huffman_encode(LOG)[:-3], b"\0\0\0", b"\0\0\0\1" + bytes(1024)):
        with pytest.raises(DecodeError):
            coders.huffman_decode(broken)
    with pytest.raises(DecodeError):
        coders.range_decode(b"\0" * 100)
    with pytest.raises(DecodeError):
        transforms.unrle(b"abc")
    with pytest.raises(DecodeError):
        transforms.unbwt_mtf(b"ab")
    with pytest.raises(DecodeError):
        transforms.unbwt(b"abc", 3)


def test_sizes_without_coding():
    for data in EDGES:
        assert coders.huffman_size(data) == len(coders.huffman_encode(data))
        assert coders.range_floor(data) <= len(coders.range_encode(data))


def test_lossy_head_drops_leading_full_bytes():
    data = b"a" * 4000
    assert coders.range_decode(coders.range_encode(data)) == data
    assert len(coders.range_encode(data, lossy_head=True)) <= len(coders.range_encode(data))


def _slow_chunks(d):
    out, start = [], 0
    while start < len(d):
        h, end = 0, min(start + coders.CHUNK_MOST, len(d))
        for p in range(start + coders.CHUNK_LEAST, end):
            h = (2 * h + d[p] * 0x45D9F3B) % 2**64
            if h % coders.CHUNK_AVERAGE == 0:
                end = p + 1
                break
        out.append((start, end - start))
        start = end
    return out


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 4110, 65536, 65537, 150000])
def test_chunks(n):
    for data in (os.urandom(n), b"\1" * n, bytes(n)):
        assert coders.cdc_chunks(data) == _slow_chunks(data)


def test_tournament_picks_the_smallest_that_decodes():
    for data in EDGES:
        for research in (False, True):
            method, coded = tournament.best(data, research)
            full = [(n, tournament.METHODS.index(m)) for m, n, ok in tournament.sizes(data, research) if ok]
            assert (len(coded), tournament.METHODS.index(method)) == min(full)
            assert tournament.decode(method, coded) == data


def test_short_inputs_stay_raw_and_long_ones_skip_the_sort():
    assert tournament.best(b"a" * 1029)[0] == "Raw"
    assert tournament.best(b"")[1] == b""
    assert "BwtMtfRle" in tournament.candidates(bytes(1 << 20))
    assert "BwtMtfRle" not in tournament.candidates(bytes((1 << 20) + 1))
    assert "BwtMtfRle" in tournament.candidates(bytes((1 << 20) + 1), research=True)


def slow_tokens(data):
    """Every distance at every position."""
    out, at = [], 0
    while at < len(data):
        best, where = 0, 0
        for d in range(1, min(at, coders.WINDOW) + 1):
            n = 0
            while n < coders.LONGEST and at + n < len(data) and data[at + n] == data[at - d + n]:
                n += 1
            if n > best:
                best, where = n, d
        out.append((0, where, best) if best >= coders.SHORTEST else (data[at], 0, 0))
        at += best if best >= coders.SHORTEST else 1
    return out


def test_matches_are_the_longest_and_then_the_nearest():
    rnd = random.Random(21)
    texts = [b"", b"a", b"aaa", b"aaaa", b"ab" * 300, b"a" * 700, LOG[:1500], bytes(range(256)) * 2]
    for _ in range(120):
        letters = bytes(rnd.sample(range(256), rnd.randrange(1, 6)))
        texts.append(bytes(rnd.choice(letters) for _ in range(rnd.randrange(300))))
        words = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 45))) for _ in range(4)]
        texts.append(b"".join(rnd.choice(words) for _ in range(rnd.randrange(20))))
    for t in texts:
        assert coders.lz_tokens(t) == slow_tokens(t)
    far = b"a needle of some bytes" + bytes(rnd.randrange(256) for _ in range(coders.WINDOW - 22))
    for gap in (b"", b"x"):
        assert coders.lz_expand(coders.lz_tokens(far + gap + far[:22])) == far + gap + far[:22]
        assert [t for t in coders.lz_tokens(far + gap + far[:22])[-6:] if t[1] == coders.WINDOW] == ([] if gap else [(0, coders.WINDOW, 22)])


def slow_huffman(data):
    """Bits from code strings, by a tree of its own; ties go to the smaller symbol, then to what was made first."""
    counts = [data.count(bytes([s])) for s in range(256)]
    trees = [(c, k, [(s, "")]) for k, (s, c) in enumerate((s, c) for s, c in enumerate(counts) if c)]
    made = 256
    while len(trees) > 1:
        trees.sort(key=lambda t: t[:2])
        (a, _, x), (b, _, y) = trees[:2]
        trees = [*trees[2:], (a + b, made, [(s, "0" + p) for s, p in x] + [(s, "1" + p) for s, p in y])]
        made += 1
    code = dict(trees[0][2])
    bits = "".join(code[b] for b in data)
    bits += "0" * (-len(bits) % 8)
    return len(data).to_bytes(4, "big") + b"".join(c.to_bytes(4, "big") for c in counts) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_huffman_bytes(monkeypatch):
    rnd = random.Random(22)
    fibonacci, a, b = b"", 1, 1
    for s in range(22):  # codes of up to 21 bits
        fibonacci += bytes([s]) * a
        a, b = b, a + b
    texts = [b"ab", b"aab", LOG[:4000], bytes(range(256)), bytes(rnd.randrange(7) ** 2 for _ in range(3000)), bytes(rnd.sample(fibonacci, len(fibonacci)))]
    for step in (coders.STEP, 100):
        monkeypatch.setattr(coders, "STEP", step)
        for t in texts:
            coded = coders.huffman_encode(t)
            assert coded == slow_huffman(t) and coders.huffman_decode(coded) == t
            with pytest.raises(DecodeError):
                coders.huffman_decode(coded[:-1])


def slow_range_size(data):
    """Bytes of an ideal coder under the static model, in exact arithmetic."""
    from fractions import Fraction

    counts = Counter(data)
    weight = {s: max(1, c * 65535 // len(data)) for s, c in counts.items()}
    total, size = sum(weight.values()), Fraction(1)
    for s, c in counts.items():
        size *= Fraction(weight[s], total) ** c
    return 1028 + math.log2(size.denominator) / 8 - math.log2(size.numerator) / 8


def test_range_sizes():
    rnd = random.Random(23)
    for t in (b"a" * 900, LOG[:3000], bytes(rnd.randrange(256) for _ in range(900)), bytes(rnd.choice(b"aaaaab") for _ in range(900))):
        coded = coders.range_encode(t)
        assert coders.range_decode(coded) == t and abs(len(coded) - slow_range_size(t)) < 8 and coders.range_floor(t) <= len(coded)
        assert coded[:4] == len(t).to_bytes(4, "big") and len(coded) >= 1028


def test_winners_by_sizes_of_their_own():
    """The tournament against sizes from this file's models: brute-force matches, sorted rotations, trees of strings."""
    rnd = random.Random(24)

    def huffman_size(x):
        return 0 if not x else 5 if len(set(x)) == 1 else len(slow_huffman(x))

    def tokens(x):
        return b"".join(b"\1" + d.to_bytes(2, "big") + n.to_bytes(2, "big") if d else bytes([0, c]) for c, d, n in slow_tokens(x))

    def bwt_mtf_rle(x):
        turns = sorted(range(len(x)), key=lambda i: (x[i:] + x[:i], i))
        table, moved = list(range(256)), []
        for c in (x[i - 1] for i in turns):
            moved.append(table.index(c))
            table.insert(0, table.pop(moved[-1]))
        y, out = turns.index(0).to_bytes(4, "big") + bytes(moved), []
        for c in y:
            if out and out[-1][1] == c and out[-1][0] < 255:
                out[-1][0] += 1
            else:
                out.append([1, c])
        return bytes(v for pair in out for v in pair)

    def predicted(x):
        table, before, out = [0] * 256, 0, []
        for c in x:
            out.append((c - table[before]) % 256)
            table[before], before = c, c
        return bytes(out)

    words = [b"status", b"login", b"user", b"of", b"the", b"and", b"error"]
    texts = [b" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 200, 300, 500)] + [LOG[:2500], bytes(rnd.randrange(256) for _ in range(1500)), b"".join(bytes([i % 251]) * 3 for i in range(700)), b"x" * 1500]
    won = set()
    for t in texts:
        sizes = {"Raw": len(t)}
        if len(t) > 1029:
            delta = bytes((c - p) % 256 for c, p in zip(t, b"\0" + t, strict=False))
            sizes |= {"Lz77Huffman": huffman_size(tokens(t)), "BwtMtfRle": huffman_size(bwt_mtf_rle(t))}
            ranged = {"DeltaPredictorRange": slow_range_size(predicted(delta)), "ContextPredictorRange": slow_range_size(predicted(t))}
            for m, size in ranged.items():
                if size < min(sizes.values()) + 8:  # near the others: the coder's own bytes decide
                    sizes[m] = len(tournament.encode(m, t))
        order = list(tournament.METHODS)
        want = min(sizes, key=lambda m: (sizes[m], order.index(m)))
        method, coded = tournament.best(t)
        assert (method, len(coded)) == (want, sizes[want])
        won.add(method)
    assert len(won) >= 3
