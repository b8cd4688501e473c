"""Suffix dedup, MinHash, decontamination and nearest neighbours against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from bytequarry.llm import ann, common, decontaminate, graph, minhash, suffix


def test_maximal_repeats():
    rnd = random.Random(3)
    for _ in range(40):
        t = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60)))
        want = {}
        for i in range(len(t)):
            for n in range(2, len(t) - i + 1):
                want.setdefault(t[i : i + n], set()).add(i)
        full = []
        for s, places in want.items():
            if len(places) > 1 and len({t[p - 1] if p else -1 for p in places}) > 1 and len({t[p + len(s)] if p + len(s) < len(t) else -1 - p for p in places}) > 1:
                full.append((len(s), sorted(places)))
        assert suffix.maximal_repeats(t, 2) == sorted(full)
    assert suffix.maximal_repeats(b"", 1) == [] and suffix.maximal_repeats(b"aa", 3) == []


def slow_removed(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - suffix.LEAST + 1):
            k = b[s : s + suffix.LEAST]
            if k in seen:
                gone[s : s + suffix.LEAST] = b"\1" * suffix.LEAST
            seen.add(k)
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def repeated_rows(words):
    rnd, base = random.Random(4), words(150, 1)
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, "a" * 5000), (5, "a" * 150), (6, "ab" * 400 + words(30, 9)), (7, base[:99]), (8, base[:100]), (9, "é" * 300)]
    passage = words(40, 2)
    for i in range(10, 70):
        rows.append((i, words(rnd.randrange(1, 60), i) + " " + passage[rnd.randrange(50) :] + " " + words(rnd.randrange(40), 100 + i)))
    for i in range(70, 90):  # edited copies
        w = base.split()
        w[rnd.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot,chunk", [(1000, 8 << 20), (3, 2000), (1000, 3000)])
def test_suffix_dedup(spark, documents, words, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "PARTITION_ENTRIES", 100)
    rows = repeated_rows(words)
    got = suffix.removed(documents(rows).repartition(3)).collect()
    assert sorted((r["id"], r["n_bytes"], r["n_removed"], len(r["starts"]), r["kept_sha256"]) for r in got) == slow_removed(rows)


@pytest.mark.parametrize("hot,many", [(3, 16), (1000, 1), (2, 2), (1000, 1000)])
def test_suffix_dedup_with_hot_grams(documents, words, monkeypatch, hot, many):
    """The path of the hot grams, in this process: workers do not see a patched limit."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "MANY", many)
    import pyarrow as pa

    rows = repeated_rows(words)
    chunks = [rows[k::3] for k in range(3)]

    def blob(part):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["id", "content"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        import zstandard

        return zstandard.ZstdCompressor().compress(sink.getvalue())

    table = pa.table({"chunk": pa.array(range(3), pa.int64()), "blob": pa.array([blob(c) for c in chunks], pa.binary())})

    def answers(sent):
        out, rows_ = [], sent.to_pylist()
        for key in {(r["kind"], r["part"]) for r in rows_}:
            out.append(suffix._answer(pa.Table.from_pylist([r for r in rows_ if (r["kind"], r["part"]) == key], suffix._MESSAGE)))
        return pa.concat_tables(out)

    of = lambda t, k: t.filter(pa.compute.equal(t.column("chunk"), k))
    pairs = answers(pa.Table.from_batches(list(suffix._send(4)(iter(table.to_batches())))))
    assert hot == many or suffix.FIRST_HOT in suffix._joined(of(pairs, 0), suffix.PAIRS)
    ends = answers(pa.concat_tables([suffix._send_ends(4)(of(table, k), of(pairs, k)) for k in range(3)]))
    both = pa.concat_tables([pairs, ends])
    got = [r for k in range(3) for r in suffix._cut(of(table, k), of(both, k)).to_pylist()]
    assert sorted((r["id"], r["n_bytes"], r["n_removed"], len(r["starts"]), r["kept_sha256"]) for r in got) == slow_removed(rows)


def test_suffix_dedup_of_odd_tables(spark, documents):
    assert suffix.removed(documents([]).limit(0)).count() == 0
    text = "one long enough line of text that is repeated word by word, so that a hundred bytes of it come back " * 2
    got = sorted((r["n_removed"], r["id"] is None) for r in suffix.removed(documents([(1, text), (1, text), (None, text)])).collect())
    assert got[0][0] < len(text) and [x[0] for x in got[1:]] == [len(text)] * 2


def slow_components(rows, n, threshold):
    def words_of(t):
        return [w for w in (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w]

    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(words):
    rnd, rows = random.Random(6), [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "ONE  two"), (5, "one two three"), (6, "x " * 3000)]
    base = [words(120, 50 + k).split() for k in range(3)]
    for i in range(7, 160):
        w = list(base[i % 3])
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 100][1]) for i in range(160, 200)]
    return rows


@pytest.mark.parametrize("n,threshold", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_minhash(documents, words, n, threshold):
    rows = near_rows(words)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(documents(rows).repartition(3), n=n, threshold=threshold).collect()}
    assert got == slow_components(rows, n, threshold)


@pytest.mark.parametrize("family,spread,share", [(40, 10**9, 3), (10**9, 5, 2)])
def test_minhash_with_families_in_many_blocks(documents, words, monkeypatch, family, spread, share):
    """Leaders with several copies of their text, families of many blocks that meet pairwise."""
    for name, value in (("FAMILY", family), ("SPREAD", spread), ("SHARE", share)):
        monkeypatch.setattr(minhash, name, value)
    rnd, rows = random.Random(12), []
    base = words(60, 3).split()
    spots = [rnd.sample(range(60), 6) for _ in range(6)]  # near to the leader all, near to each other in groups
    for i in range(140):
        w = list(base)
        for k in spots[i % 6][: 1 + i % 5]:
            w[k] = f"{i % 6}w{k}"
        if i % 4 == 0:
            w[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(documents(rows), n=3, threshold=Fraction(85, 100)).collect()}
    want = slow_components(rows, 3, Fraction(85, 100))
    assert got == want and 1 < len({c for _, c in want.values()}) < 140


def test_minhash_with_several_texts_under_an_id(documents, words):
    one, two, three = words(60, 31), words(60, 32), words(60, 33)
    rows = [(5, one), (5, two), (7, one + " more"), (9, two + " more"), (9, three), (8, three + " end"), (5, None), (4, words(60, 34)), (4, ""), (3, "short"), (2, words(60, 34)), (6, words(60, 35)), (6, words(60, 35))]
    got = {(r["id"], r["component_id"]) for r in minhash.classes(documents(rows).repartition(3)).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (8, 5), (4, 2), (2, 2), (3, 3), (6, 6)}
    assert minhash.classes(documents(rows)).count() == len(rows)


def test_minhash_of_odd_tables(documents, words):
    assert minhash.classes(documents([]).limit(0)).count() == 0
    text = words(30, 1)
    got = sorted((r["id"] or -1, r["component_id"]) for r in minhash.classes(documents([(5, text), (5, text), (9, text), (None, text), (7, words(30, 2))])).collect())
    assert got == [(-1, None), (5, 5), (5, 5), (7, 7), (9, 5)]


def test_coordinates_are_shifts_of_one_permutation():
    h = common.mix64(np.arange(1, 50, dtype=np.uint64))
    second = minhash.shifted()[:, 0]
    place = minhash.first_permutation(h)
    want = [min(int(second[(p + k) % minhash.UNIVERSE]) for p in place) for k in range(minhash.K)]
    assert minhash.signature(h).tolist() == want


def test_families_find_every_linked_pair():
    rnd, threshold = random.Random(2), Fraction(4, 5)
    leader = set(range(1, 101))
    sets = []
    for _ in range(120):
        drop = set(rnd.sample(sorted(leader), rnd.randrange(25)))
        sets.append((leader - drop) | {rnd.randrange(1000, 1030) for _ in range(rnd.randrange(12))})
    differs = [np.array(sorted(s ^ leader), np.uint64) for s in sets]
    size, component = np.array([len(s) for s in sets]), np.arange(len(sets))
    got = set(minhash.family_links(size, differs, component, component * 0, False, threshold))
    near = [5 * len(s & leader) >= 4 * len(s | leader) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert got <= want and {(i, j) for i, j in want - got if not (near[i] and near[j])} == set()


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 501)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_tiles(item, text, least):
    """Greedy string tiling by its definition: the longest common free run, the first in the item, then in the text."""
    used_i, used_t, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and not used_i[a + n] and not used_t[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return out
        for k in range(n):
            used_i[a + k] = used_t[b + k] = True
        out.append((a, b, n))


def test_tiles_are_those_of_greedy_search():
    rnd = random.Random(9)
    for _ in range(400):
        item = np.array([rnd.randrange(3, 8) for _ in range(rnd.randrange(1, 40))], np.uint64)
        text = np.array([rnd.randrange(3, 8) for _ in range(rnd.randrange(80))], np.uint64)
        least = rnd.randrange(1, 6)
        assert decontaminate.tile(item, text, least) == slow_tiles(item.tolist(), text.tolist(), least)
    one, two = range(10, 18), range(20, 28)
    item, text = np.array([1, *one, 2, 3, *two, 1], np.uint64), np.array([*two, 1, *one, 4, *one[:5]], np.uint64)
    assert sum(n for _, _, n in decontaminate.tile(item, text)) == 17


def test_tiling_of_repetitive_texts_needs_little_memory():
    import tracemalloc

    item, text = np.array([3, 4] * 100, np.uint64), np.array([3, 4] * 20_000, np.uint64)
    tracemalloc.start()
    tiles = decontaminate.tile(item, text)
    assert tiles == [(0, 0, 200)] and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_decontamination_of_reordered_fragments(spark, documents):
    one, two = " ".join(f"a{k}" for k in range(8)), " ".join(f"b{k}" for k in range(8))
    items = spark.createDataFrame([(1, f"the {one} x y {two} the")], "item_id long, text string")
    docs = documents([(1, f"{two} the {one} # {' '.join(one.split()[:5])}"), (2, two)])
    assert [(r["id"], r["n_words"], r["n_covered"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 20, 17)]
    assert [r["doc_id"] for r in decontaminate.without(docs, items).collect()] == [2]


def slow_contaminated(rows, items):
    """Every text against every item."""
    words_of = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    out = []
    for k, item in items:
        own = words_of(item)
        for i, text in rows:
            if k is None or not own:
                continue
            tiles = slow_tiles(own, words_of(text), min(decontaminate.SEED, len(own)))
            covered = sum(n for _, _, n in tiles)
            if 2 * covered >= len(own):
                out.append((i if i is not None else -1, k, len(own), covered, len(tiles)))
    return sorted(out)


def test_decontamination(spark, documents, words, monkeypatch):
    listed = [(1, words(40, 70)), (2, words(30, 71)), (3, "too short"), (4, None), (None, words(9, 3)), (5, "One!"), (6, "..."), (7, "漢字 naïve é"), (2, words(30, 71)), (8, words(12, 72) + " " + words(12, 73))]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in listed], "item_id long, text string, id string, item_key int")
    one, two, last = words(40, 70), words(30, 71).split(), words(12, 73)
    rows = [(0, None), (1, ""), (2, words(300, 1)), (3, words(20, 2) + "\n" + one.upper() + ", " + words(20, 3)), (4, " ".join(two[15:] + ["and"] + two[:15])), (5, " ".join(two[:9])), (6, one + " " + " ".join(two)), (7, "it is TOO, short"), (8, "is one of 漢字 naïve é"), (8, last), (None, last), (9, f"{last} {last} word " * 40), (9, f"{last} {last} word " * 40)]
    docs = documents(rows)
    want = slow_contaminated(rows, listed)
    assert {(i, k) for i, k, *_ in want} >= {(3, 1), (4, 2), (6, 1), (6, 2), (7, 3), (8, 5), (8, 7), (8, 8), (-1, 8), (9, 8)}
    for bits in (decontaminate.FILTER_BITS, 7):  # a filter that lets nearly everything through changes nothing
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        got = decontaminate.contaminated(docs.repartition(3), items).collect()
        assert sorted((-1 if r["id"] is None else r["id"], r["item_id"], r["n_words"], r["n_covered"], r["n_tiles"]) for r in got) == want
    clean = decontaminate.without(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 5]
    assert decontaminate.without(docs.withColumn("digest", docs.text).withColumn("DIGEST_", docs.text), items).count() == 4
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.without(docs.limit(0), items).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, []), (5080, [None] * 16), (5100, [1.0] * 4), (5120, [2.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    wide, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 20):
        s = (wide * wide[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20].tolist()
        hit += len(set(best) & {v for v, _, _ in got[q]})
        assert [r for _, _, r in got[q]] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-9 for v, score, _ in got[q])
        if 100 <= q < 400:
            assert [v for v, _, _ in got[q]] == best
    assert hit >= 0.9 * 75 * 20
    assert got[5100] == [(5120, 8.0, 1)] and got[5120] == [(5100, 8.0, 1)] and not {5000, 5020, 5040, 5060, 5080} & got.keys()
    assert ann.nearest(table.limit(0), table.limit(0), 20).count() == 0


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_of_forests(uneven):
    """Of one full block of random directions, where neighbours are hardest to tell, and of lengths that differ widely."""
    rng = np.random.default_rng(2)
    n = ann.BLOCK
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if uneven:
        x *= np.exp(rng.normal(0, 0.7, n))[:, None]
    classes = np.floor(np.log2(np.linalg.norm(x, axis=1)) * ann.LENGTH_CLASSES)
    queries, hit = x[:40], 0
    best = np.argsort(-(queries @ x.T), axis=1)[:, :21]
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        for near, (rows, _) in zip(best, ann.Forest(x[own]).search(queries, 21), strict=True):
            hit += len(set(near.tolist()) & set(own[rows].tolist()))
    assert hit >= 0.9 * 40 * 21


def test_neighbours_in_many_blocks(spark, monkeypatch):
    """Several blocks of rows and of queries, ids with several vectors, long vectors at wide angles."""
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8)) * np.exp(rng.normal(0, 0.7, 1200))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [9.0] * 8), (40, [-9.0] * 8), (41, x[41].tolist())]
    x[40] = -9.0
    x[7] = min(x[7].tolist(), [9.0] * 8)
    x[40] = min(rows[40][1], [-9.0] * 8)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(got) == 60
    for q, near in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert near == np.lexsort((np.arange(1200), -s))[:20].tolist()  # so few rows are all candidates
