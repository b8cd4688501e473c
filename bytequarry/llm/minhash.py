"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation scrambles the hashed shingles over a universe of 2**20 places; a second one, read at K circular shifts,
gives all K signature coordinates: coordinate k is the least second[(first(x) + k) mod 2**20] over the shingles x, so one
shingle costs one contiguous read of K numbers.

Rows with equal shingle sets form a class first (a grouping by a 128-bit set digest) and one of each class goes on, known by a
key of its row, so that an id that holds several texts stands for all of them. Classes that share a band are candidates. Pairs
are never expanded within a bucket: each bucket names a leader, members are verified against it on the full sets, components are
formed, and a bucket whose members lie in one component is done. The leader's text is dealt to the members of a large bucket
in shares of SHARE members, so that no leader is one task's work.

What is left are families that lie around a leader without being linked to it. They are written as differences to the
leader's set. The symmetric difference of two members is that of their differences, so their exact similarity follows from
how many differing shingles they share; an inverted index over these, which are few and mostly rare, finds every linked
pair of a family without forming the others. A pair that shares no differing shingle is either far apart or, by the
triangle inequality, linked to the leader on both sides. Families are dealt out in blocks that meet pairwise, more of them the
larger the family is.

With 32 bands of 5 rows a pair at the threshold 0.85 is missed with probability 1e-8, one at 0.8 with 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 5
K = BANDS * ROWS
SEED = 5
FAMILY, SPREAD = 500_000, 1000
"""A family of n differing shingles is dealt out in the greater of n / FAMILY (which bounds a task's memory) and the root of
n / SPREAD (which shares out the work of small ones) blocks."""
SHARE = 500
"""Members that one copy of their leader's text serves."""
SALT = 16
_TABLE: dict[int, np.ndarray] = {}


def shifted() -> np.ndarray:
    """Row i: the second permutation at i, i + 1, ..., i + K - 1 (circular); a view, not a copy."""
    if SEED not in _TABLE:
        second = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.uint32)
        _TABLE[SEED] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: K - 1]]), K)
    return _TABLE[SEED]


def first_permutation(hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(44)
    return ((place * np.uint64(0x9E375) + np.uint64(0x3C6EF)) & np.uint64(UNIVERSE - 1)).astype(np.intp)


def signature(hashes: np.ndarray) -> np.ndarray:
    """All K coordinates of a non-empty set; long sets go in blocks."""
    rows, place = shifted(), first_permutation(hashes)
    return np.min([rows[place[a : a + 4096]].min(axis=0) for a in range(0, len(place), 4096)], axis=0)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, its number mixed in."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = common.mix64(key + sig[r::ROWS].astype(np.uint64))
    return key


def shingle_set(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence as one; none without words."""
    if not len(word_hashes):
        return np.zeros(0, np.uint64)
    if len(word_hashes) < n:
        out = np.zeros(1, np.uint64) + np.uint64(len(word_hashes))
        for h in word_hashes:
            out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h)
        return out
    h = common.shingle_hashes(word_hashes, n)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, offsets = common.string_buffers(column)
    for a, b in common.slices(offsets):
        words = common.split_words(data, offsets[a : b + 1])
        for i in range(b - a):
            yield shingle_set(words.hash[words.first[i] : words.first[i + 1]], n)


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, part, serial = np.zeros(0, np.uint64), TaskContext.get().partitionId(), 0
        for batch in batches:
            size, one, two, bands = [], [], [], []
            for own in shingle_sets(batch.column(2), n):
                size.append(len(own))
                one.append(int(common.mix64(own).sum(dtype=np.uint64)))
                two.append(int(common.mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                bands.append((band_keys(signature(own)) if len(own) else none).view(np.int64))
            flat = np.concatenate([*bands, none.view(np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            row = pa.array(np.arange(serial, serial + len(size)) | part << 32, pa.int64())
            serial += len(size)
            yield pa.RecordBatch.from_arrays([row, *batch.columns[:2], pa.array(size, pa.int64()), signed(one), signed(two), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["row", "id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    content = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(content).alias("text_hash"), content.alias("content"))


def sketch(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """For each row a key of its own (fixed once written), its set's size and digest, and its band keys."""
    return _rows(df, id_col, text_col).mapInArrow(common.lean(_sketch(n)), "row bigint, id bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _verify(n: int, above: int, below: int):
    """Keeps the pairs with below * |intersection| >= above * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(shingle_sets(batch.column(2), n), shingle_sets(batch.column(3), n), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and below * both >= above * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _differences(n: int):
    """From (a, leader, component, text_a, text_leader) the size of a's set and its symmetric difference to the leader's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, differs, many = [], [], []
            for a, b in zip(shingle_sets(batch.column(3), n), shingle_sets(batch.column(4), n), strict=True):
                d = np.setxor1d(a, b, assume_unique=True)
                size.append(len(a))
                many.append(len(d))
                differs.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(many, pa.int64()), pa.array(differs, pa.binary())], ["a", "leader", "component", "size", "many", "differs"])

    return run


def family_links(size: np.ndarray, differs: list[np.ndarray], component: np.ndarray, block: np.ndarray, across: bool, threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs (i, j), j < i, of members in different components whose sets are as similar as the threshold.

    differs are symmetric differences to one common set. With across, only pairs of members of different blocks count."""
    many = np.array([len(d) for d in differs], np.int64)
    owner = np.repeat(np.arange(len(differs)), many)
    flat = np.concatenate(differs) if differs else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    owner_by = owner[order]
    index = np.empty(len(flat), np.int64)
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]]) if len(flat) else np.zeros(0, bool)
    index[order] = np.cumsum(new) - 1
    edge = np.append(np.flatnonzero(new), len(flat))
    at, out = 0, []
    above, below = threshold.numerator, threshold.denominator
    for i in range(len(differs)):
        own = index[at : at + many[i]]
        at += many[i]
        own = own[edge[own + 1] - edge[own] > 1]
        if not len(own) or not i:
            continue
        both = np.bincount(np.concatenate([owner_by[edge[e] : edge[e + 1]] for e in own.tolist()]), minlength=len(differs))[:i]
        common_size = (size[i] + size[:i] - (many[i] + many[:i] - 2 * both)) // 2
        linked = (both > 0) & (common_size > 0) & (below * common_size >= above * (size[i] + size[:i] - common_size)) & (component[:i] != component[i])
        if across:
            linked &= block[:i] != block[i]
        out += [(i, j) for j in np.flatnonzero(linked).tolist()]
    return out


def _families(threshold: Fraction):
    def run(rows: pa.Table) -> pa.Table:
        ids, size, component, block = (rows.column(x).to_numpy() for x in ("a", "size", "component", "block"))
        differs = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("differs")]
        pairs = family_links(size, differs, component, block, rows.column("low")[0].as_py() != rows.column("high")[0].as_py(), threshold)
        return pa.Table.from_arrays([pa.array([int(max(ids[i], ids[j])) for i, j in pairs], pa.int64()), pa.array([int(min(ids[i], ids[j])) for i, j in pairs], pa.int64())], ["a", "b"])

    return run


def beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, leader, members, ...) with text_a and text_leader; texts has (row, content). A leader's text is copied once for
    each SHARE of its members, and members are dealt to the copies."""
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / SHARE)).cast("int"))
    heads = dealt.select("leader", "share").distinct().join(texts.select(F.col("row").alias("leader"), F.col("content").alias("text_leader")), "leader")
    own = dealt.join(texts.select(F.col("row").alias("a"), F.col("content").alias("text_a")), "a")
    return own.join(heads, ["leader", "share"]).drop("share", "members")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id, n_shingles, component_id) for each row.

    Components are those of all pairs at the threshold; component_id is the smallest id in it. Null texts are empty; a document
    without words is linked with nothing. Rows with a null id take no part and have a null component. Rows that repeat an id are
    one document to the links: if their texts differ, whatever is near to any of them is linked to the id. Texts are read whole."""
    rows = common.spool(sketch(df, id_col, text_col, n), "minhash-sketch")
    some = rows.filter("n_shingles > 0 and id is not null")
    of_set = ["set_a", "set_b", "n_shingles"]
    by_set = some.groupBy(*of_set).agg(F.min(F.struct("id", "row", "text_hash")).alias("rep")).select(*of_set, F.col("rep.id").alias("rep_id"), F.col("rep.row").alias("rep"), F.col("rep.text_hash").alias("rep_hash"))
    reps = common.spool(by_set.select("rep", "rep_id", "rep_hash"), "minhash-reps")
    # Rows whose class is named after another id; the digest's join is by distinct (id, set), so that copies of a row are one.
    copies = common.spool(some.select("id", *of_set).distinct().join(by_set, of_set).filter("id <> rep_id").select(F.col("id").alias("a"), F.col("rep_id").alias("b")).distinct(), "minhash-copies")
    keys = some.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), F.explode("bands").alias("key"))
    keys = keys.distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = common.spool(keys.join(shared, "key"), "minhash-buckets")
    popular = buckets.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("weight"))
    weighed = common.spool(buckets.join(popular, "rep").select("key", "rep", "weight", "size"), "minhash-weighed")
    common.drop_spooled(buckets)
    # The texts that any pair can need, one for each class.
    wanted = reps.join(weighed.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("row"), F.col("rep_id").alias("id"), F.col("rep_hash").alias("text_hash"))
    texts = common.spool(_rows(df, id_col, text_col).join(wanted.hint("shuffle_hash"), ["id", "text_hash"]).select("row", "content").dropDuplicates(["row"]), "minhash-texts")
    lead = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("lead")).select("key", (-F.col("lead.minus")).alias("leader"))
    led = common.spool(weighed.select("key", "rep", "size").join(lead, "key"), "minhash-led")
    stars = led.filter("rep <> leader").groupBy(F.col("rep").alias("a"), "leader").agg(F.max("size").alias("members"))
    verify = _verify(n, threshold.numerator, threshold.denominator)
    links = common.spool(beside(stars, texts).select("a", "leader", "text_a", "text_leader").mapInArrow(common.lean(verify), "a bigint, b bigint"), "minhash-links")
    found = graph.components(links, "minhash-components")
    placed = led.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    unsettled = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    members = placed.join(unsettled, "key", "left_semi").filter("rep <> leader").groupBy(F.col("rep").alias("a"), "leader", "component").agg(F.max("size").alias("members"))
    families = beside(members, texts).select("a", "leader", "component", "text_a", "text_leader")
    families = common.spool(families.mapInArrow(common.lean(_differences(n)), "a bigint, leader bigint, component bigint, size bigint, many bigint, differs binary"), "minhash-families")
    total = F.sum("many")
    blocks = families.groupBy("leader").agg(F.greatest(F.ceil(total / FAMILY), F.ceil(F.sqrt(total / SPREAD)), F.lit(1)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = families.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")).join(salted, ["leader", "salt"]).drop("salt")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("a", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "a", "size", "component", "block", "differs")
    more = common.spool(dealt.repartition("leader", "low", "high").groupBy("leader", "low", "high").applyInArrow(_families(threshold), "a bigint, b bigint").distinct(), "minhash-more")
    # From classes to ids; a class and another one of the same id need no link.
    name = lambda side: reps.select(F.col("rep").alias(side), F.col("rep_id").alias(f"{side}_id"))
    between = links.union(more).join(name("a"), "a").join(name("b"), "b").filter("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    joined = graph.components(between.union(copies), "minhash-components")
    # joined and the sketches are all that the result reads
    for done in (weighed, texts, led, links, found, families, more, copies, reps):
        common.drop_spooled(done)
    return rows.select("id", "n_shingles").join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"), n=3, threshold=Fraction(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of five-word shingles, similarity 0.8 or more, that with the smallest id (rows that repeat
    it stay with it). Rows with a null id stay."""
    gone = classes(docs, n=5, threshold=Fraction(4, 5)).filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
