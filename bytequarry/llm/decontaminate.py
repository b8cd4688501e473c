"""Benchmark decontamination by greedy string tiling.

Texts and items are sequences of words (letters, digits and bytes over 0x7F; A-Z lower-cased; anything else separates), each
known by a 64-bit hash. Runs of SEED words that a text shares with an item are the seeds; an item of fewer words has one seed,
itself. For each pair of text and item that share a seed, the longest common runs of unmarked words are found by running
Karp-Rabin, marked as tiles and taken out, until no run of a seed's length is left. Tiles may come in any order, so a passage
whose sentences were moved about is still covered. A text is contaminated by an item of whose words the tiles cover the threshold.

1. The benchmark becomes a table of items and a table of seeds by hash.
2. The documents are read once, whatever the benchmark's size. A bit filter of the seeds (at most 2**FILTER_BITS bits, so of a
   bounded size) leaves the few words of a text that can lie in a tile; texts without any are done.
3. What is left is joined to the seeds by hash, salted, since a seed may stand in a third of all texts, and gives the pairs.
4. Each pair meets its item's words, salted as well, and is tiled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import SEPARATORS

SEED = 5
THRESHOLD = 0.5
FILTER_BITS = 26
"""Bits of the seed filter, at most 2**26 (8 MiB); a larger benchmark only lets more words through to the join."""
SALT = 16
GAP = np.uint64(0)
"""Stands between words that are not neighbours in the text; no word has this hash."""

_ROWS = pa.list_(pa.int64())


def words_of(data: np.ndarray, offsets: np.ndarray) -> common.Words:
    w = common.split_words(data, offsets, separators=SEPARATORS)
    w.hash[w.hash == GAP] = np.uint64(1)
    return w


def running(words: np.ndarray) -> np.ndarray:
    """Prefix sums of the running hash of a sequence."""
    up, _ = common.powers(len(words))
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(common.mix64(words) * up[: len(words)], out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of so many words, in constant time each."""
    if len(prefix) <= length:
        return np.zeros(0, np.uint64)
    _, down = common.powers(len(prefix))
    return common.mix64((prefix[length:] - prefix[:-length]) * down[: len(prefix) - length] + np.uint64(length))


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first; ties go to the earlier in the item, then in the text.

    Marked words take no further part on either side. Each round finds the greatest length at which free runs of both sides have
    a hash in common (by halving, as shorter runs of a common run are common too) and marks the runs of that length, so rounds
    have falling lengths. Memory is in proportion to the two sequences, however repetitive they are."""
    free_i, free_t = np.ones(len(item), bool), text != GAP
    whole_i, whole_t = running(item), running(text)
    tiles: list[tuple[int, int, int]] = []

    def starts(free: np.ndarray, length: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[length:] == taken[:-length])

    def common_runs(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free starts in the item that have a partner; the partners' hashes, sorted, with their starts."""
        a, b = starts(free_i, length), starts(free_t, length)
        h_a, h_b = run_hashes(whole_i, length)[a], run_hashes(whole_t, length)[b]
        both = np.intersect1d(h_a, h_b)
        b = b[np.isin(h_b, both)]
        h_b = run_hashes(whole_t, length)[b]
        order = np.argsort(h_b, kind="stable")
        some = np.isin(h_a, both)
        return a[some], h_a[some], h_b[order], b[order]

    high = min(len(item), len(text))
    while high >= least and len(common_runs(least)[0]):
        low = least
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common_runs(mid)[0]) else (low, mid - 1)
        a_all, h_a, h_b, b_all = common_runs(low)
        open_t = np.zeros(len(text), bool)
        open_t[b_all] = True
        end = 0
        for a, l, r in zip(a_all.tolist(), np.searchsorted(h_b, h_a, "left").tolist(), np.searchsorted(h_b, h_a, "right").tolist(), strict=True):
            if a < end:
                continue
            partners = b_all[l:r]
            partners = partners[open_t[partners]]
            for b in partners.tolist():
                if (item[a : a + low] == text[b : b + low]).all():
                    free_i[a : a + low] = False
                    free_t[b : b + low] = False
                    open_t[max(0, b - low + 1) : b + low] = False
                    tiles.append((a, b, low))
                    end = a + low
                    break
        high = low - 1
    return tiles


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = common.string_buffers(batch.column(1))
        for a, b in common.slices(offsets):
            w = words_of(data, offsets[a : b + 1])
            rows = []
            for i in range(b - a):
                own = w.hash[w.first[i] : w.first[i + 1]]
                if len(own):
                    least = min(SEED, len(own))
                    rows.append((part << 32 | serial, batch.column(0)[a + i].as_py(), least, own.view(np.int64), np.unique(run_hashes(running(own), least)).view(np.int64)))
                    serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), _ROWS, _ROWS))], ["item_key", "item_id", "least", "words", "seeds"])


def _candidates(marks, shift: int, lengths: list[int]):
    """Of each text with words that can lie in a tile: these words, GAP between those that are not neighbours, and its seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, bits = TaskContext.get().partitionId(), 0, marks.value
        for batch in batches:
            data, offsets = common.string_buffers(batch.column(1))
            key, row, digest, sequence, seeds = [], [], [], [], []
            for a, b in common.slices(offsets):
                w = words_of(data, offsets[a : b + 1])
                prefix = running(w.hash)
                text = np.repeat(np.arange(b - a), np.diff(w.first))
                found = []
                for n in lengths:
                    h = run_hashes(prefix, n)
                    at = h >> np.uint64(shift)
                    hit = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.intp)] >> (at & np.uint64(63)) & np.uint64(1))
                    hit = hit[text[hit] == text[hit + n - 1]]
                    found.append((hit, h[hit], np.full(len(hit), n)))
                at, h, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, h, n = at[order], h[order], n[order]
                edge = np.searchsorted(at, w.first)
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    own = slice(edge[i], edge[i + 1])
                    place = np.unique(np.concatenate([at[own][n[own] > k] + k for k in range(max(lengths))]))
                    cut = np.flatnonzero(np.diff(place) > 1) + 1
                    key.append(part << 32 | serial)
                    serial += 1
                    row.append(a + i)
                    digest.append(hashlib.sha256(data[offsets[a + i] : offsets[a + i + 1]].tobytes()).hexdigest())
                    sequence.append(np.insert(w.hash[place], cut, GAP).view(np.int64))
                    seeds.append(np.unique(h[own]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(digest, pa.string()), pa.array(sequence, _ROWS), pa.array(seeds, _ROWS)],
                ["key", "id", "digest", "sequence", "seeds"],
            )

    return run


def _tiled(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: np.array(x.values.to_numpy()).view(np.uint64)
        for batch in batches:
            rows, out = [], [[], [], []]
            for r, (least, words, sequence) in enumerate(zip(batch.column("least").to_pylist(), batch.column("words"), batch.column("sequence"), strict=True)):
                item = numbers(words)
                tiles = tile(item, numbers(sequence), least)
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * len(item):
                    rows.append(r)
                    for o, v in zip(out, (len(item), covered, len(tiles)), strict=True):
                        o.append(v)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("id", "digest", "item_id")] + [pa.array(o, pa.int64()) for o in out], ["id", "digest", "item_id", "n_words", "n_covered", "n_tiles"])

    return run


def _found(docs: DataFrame, items: DataFrame, threshold: float, id_col: str | None, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(id, digest, item_id, n_words, n_covered, n_tiles) for each row of docs and item whose tiles cover the threshold."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("content")).filter("id is not null and content is not null")
    known = common.spool(asked.mapInArrow(_items, "item_key bigint, item_id bigint, least int, words array<bigint>, seeds array<bigint>"), "tiling-items")
    seeds = known.select("item_key", F.explode("seeds").alias("seed"))
    lengths = sorted(r["least"] for r in known.select("least").distinct().collect())  # at most SEED values
    bits = min(FILTER_BITS, max(12, (2048 * seeds.count()).bit_length()))
    marked = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = marked.agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    rows = docs.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("id"), F.col(text_col).cast("string").alias("content"))
    if not lengths:
        rows = rows.limit(0)
    sent = spark.sparkContext.broadcast(marks)
    left = common.spool(rows.mapInArrow(common.lean(_candidates(sent, 64 - bits, lengths or [SEED])), "key bigint, id bigint, digest string, sequence array<bigint>, seeds array<bigint>"), "tiling-texts")
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALT)])).alias("salt")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt")
    pairs = left.select("key", salt, F.explode("seeds").alias("seed")).join(seeds.select("*", salts), ["seed", "salt"]).select("key", "item_key").distinct()
    pairs = pairs.join(left.drop("seeds"), "key").withColumn("salt", salt).join(known.drop("seeds").select("*", salts), ["item_key", "salt"])
    return pairs.select("id", "digest", "item_id", "least", "words", "sequence").mapInArrow(common.lean(_tiled(threshold)), "id bigint, digest string, item_id bigint, n_words bigint, n_covered bigint, n_tiles bigint")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, n_words, n_covered, n_tiles) for each row of docs and item of whose n_words words its tiles cover the
    threshold.

    Null and empty texts share nothing; texts of any length are read whole; repeated rows of docs and of items are each reported.
    Items with a null id or text, or without words, are not searched. An empty table on either side gives no rows."""
    return _found(docs, items, threshold, id_col, text_col, item_col, item_text_col).drop("digest")


def without(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs less its contaminated rows; all columns as they are, whatever their names."""
    gone = common.spool(_found(docs, items, threshold, None, text_col, item_col, item_text_col).select("digest").distinct(), "tiling-gone")
    digest = common.fresh("digest", docs.columns)
    own = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    return own.join(gone.withColumnRenamed("digest", digest), digest, "left_anti").drop(digest)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_words", "n_covered", "n_tiles", F.round(F.col("n_covered") / F.col("n_words"), 6).alias("coverage"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, common.table(spark, sf_dir, "benchmark"))
