"""Stupid-backoff language-model scores, as a relational plan over packed n-gram tables.

1. Documents are packed into chunks of about CHUNK_BYTES of text (compressed), written to the shared folder.
2. Each chunk sends, for each order and hash partition, its distinct n-grams (hashes, sorted) with their counts: the map
   side of a group-by. One row carries all n-grams of a chunk that fall in a partition.
3. Each partition adds up the counts: the n-gram count table, partitioned by hash. It joins them back to the rows that
   asked, as counts in the order in which the chunk sent its n-grams, so that no hash travels twice.
4. The chunk's n-grams are exploded again, meet their counts, and are summed for each document.

A frequent n-gram is one entry of each chunk however often it occurs: a partition takes PARTITION_WORDS words of text and, for
each of its n-grams that stand everywhere, one entry of every 8 MiB. With very many chunks a row thins out to a single n-gram,
which is the plain relational join. Partitions and the tasks that score chunks are numbered by the corpus, not by the session.

Each document is scored by all the others: c are counts over the whole corpus less the document's own, N its words less theirs.
(With its own counts in, every n-gram of a document would be seen, and a text that occurs nowhere else would score best.)
Score of a word w after u v:
    c(uvw) / c(uv)               if c(uvw) > 0
    A * c(vw) / c(v)             else, if c(vw) > 0
    A * A * max(c(w), 1) / N     else
The first and second words of a document start at the lower orders, without A for the orders they cannot have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, BACKOFF = 3, 0.4
CHUNK_BYTES = 8 << 20
PARTITION_WORDS = 2_500_000
MARGIN_BITS = 20
"""n-gram hashes have so many bits more than the number of words, 48 at least: an n-gram shares its hash with another one with
probability 2**-20 at most."""


def hash_bits(n_words: int) -> int:
    return min(63, max(48, n_words.bit_length() + MARGIN_BITS))


def ngrams(words: common.Words, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, and which words have one within their text."""
    m = len(words.hash)
    out, whole = np.zeros(m, np.uint64), np.zeros(m, bool)
    if m >= n:
        out[n - 1 :] = common.shingle_hashes(words.hash, n) >> np.uint64(64 - bits)
        place = np.arange(m) - np.repeat(words.first[:-1], np.diff(words.first))
        whole = place >= n - 1
    return out, whole


def _open(blob: bytes) -> tuple[pa.Array, common.Words]:
    ids, data, offsets = common.open_chunk(blob)
    return ids, common.split_sliced(data, offsets)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(_open(b.as_py())[1].start) for b in batch.column("blob")], pa.int64())], ["n_words"])


def _send(parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                words = _open(blob.as_py())[1]
                for order in range(1, ORDER + 1):
                    h, whole = ngrams(words, order, bits)
                    own, count = np.unique(h[whole], return_counts=True)
                    edge = common.part_bounds(own, parts, bits)
                    some = np.flatnonzero(np.diff(edge))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), order, np.int32)),
                            pa.array(some.astype(np.int32)),
                            pa.array(np.full(len(some), chunk, np.int64)),
                            pa.array([common.pack_sorted(own[edge[p] : edge[p + 1]]) for p in some], pa.binary()),
                            pa.array([common.pack_numbers(count[edge[p] : edge[p + 1]]) for p in some], pa.binary()),
                        ],
                        ["order", "part", "chunk", "hashes", "counts"],
                    )

    return run


def _count(rows: pa.Table) -> pa.Table:
    """The count table of one partition of one order, joined to the chunks that asked."""
    asked = [common.unpack_sorted(x.as_py()) for x in rows.column("hashes")]
    own, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, np.concatenate([common.unpack_numbers(x.as_py()) for x in rows.column("counts")]).astype(np.float64), len(own))
    back = np.split(total[place].astype(np.uint64), np.cumsum([len(x) for x in asked])[:-1])
    return pa.Table.from_arrays([rows.column("order"), rows.column("part"), rows.column("chunk"), pa.array([common.pack_numbers(x) for x in back], pa.binary())], ["order", "part", "chunk", "counts"])


def _score(n_all: int, bits: int):
    names = ["id", "n_words", "log_sum"]

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        ids, n_words, scores = [], [], []
        by_order: dict[int, list] = {k: [] for k in range(1, ORDER + 1)}
        for o, p, c in zip(answers.column("order").to_pylist(), answers.column("part").to_pylist(), answers.column("counts"), strict=True):
            by_order[o].append((p, c))
        for blob in chunks.column("blob"):
            own_ids, words = _open(blob.as_py())
            m, per = len(words.hash), np.diff(words.first)
            doc = np.repeat(np.arange(len(per)), per)
            log = np.zeros(m)
            before = np.zeros(m)
            for order in range(1, ORDER + 1):
                h, has = ngrams(words, order, bits)
                c = np.zeros(m)
                if has.any():
                    total = np.concatenate([common.unpack_numbers(x.as_py()) for _, x in sorted(by_order[order], key=lambda x: x[0])])
                    which = np.unique(h[has], return_inverse=True)[1].ravel()
                    _, mine, times = np.unique(which * len(per) + doc[has], return_inverse=True, return_counts=True)
                    c[has] = total[which] - times[mine.ravel()].astype(np.float64)
                if order == 1:
                    log = np.log(np.maximum(c, 1) / np.maximum(n_all - per[doc], 1)) if m else log
                else:
                    seen = c > 0
                    log = np.where(seen, np.log(np.where(seen, c, 1) / np.where(seen, before, 1)), log + has * np.log(BACKOFF))
                before = np.concatenate([[0.0], c[:-1]]) if m else c
            # sums of their own for each document, so that a long chunk costs no accuracy
            sums = np.add.reduceat(np.concatenate([log, [0.0]]), words.first[:-1]) if m else np.zeros(len(per))
            ids.append(own_ids)
            n_words.append(per)
            scores.append(np.where(per > 0, sums, 0.0))
        if not ids:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        return pa.Table.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(np.concatenate(scores))], names)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_sum) for each row: natural logarithm of the product of its words' stupid-backoff scores.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; texts are read whole, a long one a mebibyte at a
    time. Null and empty texts have no words and score 0. Repeated rows count as often as they occur and are each scored, by
    their copies too; ids are carried along only. No rows give none."""
    chunks = common.chunks(docs, id_col, text_col, CHUNK_BYTES, "lm-chunks")
    counted = chunks.select("blob").mapInArrow(common.lean(_words), "n_words bigint").agg(F.sum("n_words"), F.count("*")).first()
    n_all, n_chunks = counted[0] or 0, counted[1]
    parts, bits = max(1, -(-n_all // PARTITION_WORDS)), hash_bits(n_all)
    sent = chunks.mapInArrow(common.lean(_send(parts, bits)), "order int, part int, chunk bigint, hashes binary, counts binary")
    number = (F.col("order") - 1) * parts + F.col("part")
    answers = common.grouped(sent, ORDER * parts, number, ["order", "part"], _count, "order int, part int, chunk bigint, counts binary")
    deal = lambda df: common.dealt_out(df, n_chunks, "chunk")
    return deal(chunks).cogroup(deal(answers)).applyInArrow(_score(n_all, bits), "id bigint, n_words bigint, log_sum double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_score is the mean over the document's words, which compares documents of any length; log_sum the sum."""
    found = score(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.round(F.col("log_sum") / F.greatest("n_words", F.lit(1)), 6).alias("log_score"), F.round("log_sum", 6).alias("log_sum"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u, len(ws) AS own_n
  FROM w, unnest(range(1, len(ws) + 1)) AS r(i)
), own_1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w
), own_2 AS (SELECT doc_id, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY doc_id, v, w
), own_3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY doc_id, u, v, w
), one AS (SELECT doc_id, w, sum(c) OVER (PARTITION BY w) - c AS c FROM own_1
), two AS (SELECT doc_id, v, w, sum(c) OVER (PARTITION BY v, w) - c AS c FROM own_2
), three AS (SELECT doc_id, u, v, w, sum(c) OVER (PARTITION BY u, v, w) - c AS c FROM own_3
), n AS (SELECT count(*) AS n FROM t
), s AS (
  SELECT t.doc_id,
    CASE WHEN c3.c > 0 THEN ln(c3.c / d2.c)
         WHEN c2.c > 0 THEN ln(c2.c / d1.c) + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(greatest(c1.c, 1) / greatest(n.n - t.own_n, 1)) + CASE WHEN t.v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END END AS l
  FROM t CROSS JOIN n JOIN one c1 ON c1.doc_id = t.doc_id AND c1.w = t.w
  LEFT JOIN one d1 ON d1.doc_id = t.doc_id AND d1.w = t.v
  LEFT JOIN two c2 ON c2.doc_id = t.doc_id AND c2.v = t.v AND c2.w = t.w
  LEFT JOIN two d2 ON d2.doc_id = t.doc_id AND d2.v = t.u AND d2.w = t.v
  LEFT JOIN three c3 ON c3.doc_id = t.doc_id AND c3.u = t.u AND c3.v = t.v AND c3.w = t.w
), sums AS (SELECT doc_id, sum(l) AS l FROM s GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, round(coalesce(l, 0) / greatest(len(w.ws), 1), 6) AS log_score, round(coalesce(l, 0), 6) AS log_sum
FROM w LEFT JOIN sums ON sums.doc_id = w.doc_id
"""
