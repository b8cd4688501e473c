"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each tree is a sorted array of BITS-long strings of hyperplane signs. A query descends in every tree to the rows that
share its longest prefix; then all trees ascend together, one bit at a time and within a bit one tree after the other, until the
ranges they span hold CANDIDATES rows. The union of the ranges is scored on the original vectors.

Strings of signs tell angles and not lengths, so rows are indexed by length class (four to a doubling), within which the order
of angles is nearly that of inner products, and in blocks of at most about BLOCK distinct vectors. Each block's forest is built
once and written; the stated queries meet it in blocks of QUERY_BLOCK, each task with one forest and one block of queries, so
that no task grows with the table. Equal vectors are searched once; of each the k + 1 smallest ids are kept, which is all that
k neighbours other than the query itself can need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES, BITS = 100, 24
BLOCK, QUERY_BLOCK = 16384, 1024
CANDIDATES = 9000
"""Rows in the ranges, copies across trees counted, at which the ascent in a forest stops. A forest of no more rows than that has
to give all of them."""
LENGTH_CLASSES = 4
"""Classes of vector length to a doubling."""


class Forest:
    """vectors, and for each tree the rows in order of their strings and the sorted strings."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray | None = None, strings: np.ndarray | None = None, seed: int = 3):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.single = self.vectors.astype(np.float32)
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], TREES * BITS)).astype(np.float32)
        if order is None:
            keys = self.keys(self.single)
            order = np.argsort(keys, axis=0, kind="stable").T.astype(np.uint32)
            strings = np.take_along_axis(keys.T, order, 1)
        self.order, self.sorted = order, strings

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, TREES) strings of BITS signs as integers."""
        out = np.empty((len(vectors), TREES), np.uint32)
        weight = (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)).astype(np.float32)
        for a in range(0, len(vectors), 1024):
            signs = (vectors[a : a + 1024] @ self.planes > 0).reshape(-1, TREES, BITS)
            out[a : a + 1024] = (signs @ weight).astype(np.uint32)
        return out

    def ranges(self, keys: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of rows at which the ascent stops, with so many rows in all."""
        n = len(keys)
        low, high = np.zeros((n, TREES), np.int64), np.zeros((n, TREES), np.int64)
        rest, a_was, b_was = np.arange(n), low, high
        for length in range(BITS, -1, -1):
            spare = np.uint32((1 << (BITS - length)) - 1)
            part = keys[rest]
            a = np.stack([np.searchsorted(self.sorted[t], part[:, t] & ~spare, "left") for t in range(TREES)], 1)
            b = np.stack([np.searchsorted(self.sorted[t], part[:, t] | spare, "right") for t in range(TREES)], 1)
            # rows held once the first trees have ascended by this bit
            held = (b_was - a_was).sum(axis=1)[:, None] + np.cumsum((b - a) - (b_was - a_was), axis=1)
            up = np.arange(TREES) <= (held < want).sum(axis=1)[:, None]
            low[rest], high[rest] = np.where(up, a, a_was), np.where(up, b, b_was)
            short = held[:, -1] < want
            rest, a_was, b_was = rest[short], a[short], b[short]
            if not len(rest):
                break
        return low, high

    def candidates(self, low: list[int], high: list[int]) -> np.ndarray:
        mark = np.zeros(len(self.single), bool)
        for t in range(TREES):
            mark[self.order[t, low[t] : high[t]]] = True
        return np.flatnonzero(mark)

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows of at least k nearest candidates (ties at the end kept) and their scores."""
        queries = np.ascontiguousarray(queries, np.float64)
        n = len(self.single)
        low, high = self.ranges(self.keys(queries.astype(np.float32)), CANDIDATES if n > CANDIDATES else n * TREES)
        out = []
        for q, a, b in zip(queries, low.tolist(), high.tolist(), strict=True):
            rows = self.candidates(a, b)
            rough = self.single[rows] @ q.astype(np.float32)
            if len(rows) > k:
                # single precision only decides what is surely out of reach
                bar = np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-4 * (1 + np.abs(rough).max())
                rows = rows[~(rough < bar)]
            # products added one after the other, so that a score does not depend on how many are computed at once
            out.append((rows, np.cumsum(self.vectors[rows] * q, axis=1)[:, -1]))
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _build(rows: pa.Table) -> pa.Table:
    forest = Forest(_matrix(rows.column("vector")))
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (forest.vectors, forest.order, forest.sorted)]
    ids = rows.column("ids").combine_chunks().cast(pa.list_(pa.int64()))
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.Table.from_arrays([pa.array(rows.column(c)[:1].to_pylist(), t) for c, t in (("dim", pa.int32()), ("length", pa.int32()), ("block", pa.int32()))] + [held, *blobs], ["dim", "length", "block", "ids", "vectors", "rows", "strings"])


def _search(k: int):
    names = ["query", "vec_id", "score"]
    types = [pa.int64(), pa.int64(), pa.float64()]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        one = index.slice(0, 1).to_batches()[0]
        ids, dim = one.column("ids").to_pylist()[0], one.column("dim")[0].as_py()
        read = lambda c, t: np.frombuffer(one.column(c)[0].as_buffer(), t)
        forest = Forest(read("vectors", np.float64).reshape(-1, dim), read("rows", np.uint32).reshape(TREES, -1), read("strings", np.uint32).reshape(TREES, -1))
        query, vec, score = [], [], []
        for q, (near, s) in zip(queries.column("query").to_pylist(), forest.search(_matrix(queries.column("vector")), k + 1), strict=True):
            found = sorted((-x, i) for r, x in zip(near.tolist(), s.tolist(), strict=True) for i in ids[r])[: k + 1]
            query += [q] * len(found)
            vec += [i for _, i in found]
            score += [-x for x, _ in found]
        return pa.Table.from_arrays([pa.array(query, types[0]), pa.array(vec, types[1]), pa.array(score, types[2])], names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors, its own id apart.

    Nearness is the inner product in double precision, ties go to the smaller id. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, on either side; vectors meet only those of their own dimension. Fewer than k
    candidates give fewer rows; tables without usable rows give none. A repeated id counts once, with the least of its usable
    vectors (compared component by component). Other columns are not read."""
    x = F.col("vector")

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null")
        sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
        # 0.0 and -0.0 hash alike
        own = own.filter(F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform(x, lambda c: c + F.lit(0.0)))
        return own.withColumns({"a": F.xxhash64(x), "b": F.xxhash64(F.lit(1), x)})

    by = Window.partitionBy("a", "b").orderBy("id")
    single = lambda df: df.groupBy("id").agg(F.min(F.struct("vector", "a", "b")).alias("v")).select("id", "v.*")
    first = single(usable(vectors)).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k + 1)
    distinct = common.spool(first.groupBy("a", "b").agg(F.any_value("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")), "ann-rows")
    asked = common.spool(single(usable(queries)), "ann-queries")
    points = asked.groupBy("a", "b").agg(F.any_value("vector").alias("vector"), F.min("id").alias("query"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c))
    length = F.when((norm > 0) & (norm < float("inf")), F.floor(F.log2(norm) * LENGTH_CLASSES)).otherwise(F.signum(norm) * 5000).cast("int")
    classed = distinct.select(F.size("vector").alias("dim"), length.alias("length"), "a", "vector", "ids")
    blocks = classed.groupBy("dim", "length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classed.join(blocks, ["dim", "length"]).withColumn("block", F.pmod("a", F.col("blocks")).cast("int"))
    index = dealt.select("dim", "length", "block", "vector", "ids").groupBy("dim", "length", "block").applyInArrow(_build, "dim int, length int, block int, ids array<array<bigint>>, vectors binary, rows binary, strings binary")
    index = common.spool(index, "ann-forests")
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    units = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    wanted = points.select(F.size("vector").alias("dim"), F.pmod("b", F.lit(query_blocks)).cast("int").alias("query_block"), "vector", "query")
    wanted = wanted.join(index.select("dim", F.col("length").alias("in_length"), F.col("block").alias("in_block")), "dim")
    pairs = units.groupBy("dim", "length", "block", "query_block").cogroup(wanted.groupBy("dim", "in_length", "in_block", "query_block"))
    found = common.spool(pairs.applyInArrow(_search(k), "query long, vec_id long, score double"), "ann-found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    named = points.select("a", "b", "query").join(asked.select("a", "b", F.col("id").alias("query_id")), ["a", "b"]).select("query", "query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.join(top, "query").filter("query_id <> vec_id").select("query_id", F.row_number().over(own).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


# All pairs of queries and rows. Up to CANDIDATES rows of a length class the forests have to give the same; beyond that they do
# so with the recall that the README states.
ORACLE = """
WITH v AS (
  SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL)
  WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
