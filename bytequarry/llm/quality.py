"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every position of the whole text, and activations are max-pooled over
overlapping chunks. The mean and the maximum over all chunks of a text enter one logistic unit. For scoring, the
embedding and two taps at a time are folded into tables over byte pairs, so a filter costs three look-ups a byte.

Training (Adam, on a bounded labelled sample) passes gradients through the positions that won the pooling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labels

WIDTH, FILTERS, EMBED = 6, 12, 8
STEP = 128
"""Chunks are 2 * STEP bytes long and start every STEP bytes."""
EPOCHS, BATCH, RATE = 10, 32, 0.01
CROP = 0.3
"""Share of the good texts that an epoch sees as a short piece: a piece of a good text is good, and texts may be short."""
SLICE = 1 << 18
"""Bytes pooled at a time, whole steps; bounds a worker's memory, not the text: all texts are pooled slice by slice."""


@dataclass
class Net:
    embed: np.ndarray  # 256, EMBED
    filters: np.ndarray  # WIDTH, EMBED, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    shift: np.ndarray  # 1

    def taps(self) -> list[np.ndarray]:
        """For each tap, activations by byte: what a step of training can afford to make anew."""
        taps = [self.embed @ w for w in self.filters]
        taps[0] = taps[0] + self.bias
        return [np.ascontiguousarray(t, np.float32) for t in taps]

    def tables(self) -> list[np.ndarray]:
        """For each pair of taps, activations by byte pair."""
        taps = [self.embed @ w for w in self.filters]
        pairs = [(a[:, None, :] + b[None, :, :]).reshape(65536, -1) for a, b in zip(taps[::2], taps[1::2], strict=True)]
        pairs[0] += self.bias
        return [np.ascontiguousarray(p, np.float32) for p in pairs]


def steps(lengths: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-lengths // STEP))


def _pieces(texts: list[np.ndarray]) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Texts cut at whole steps into pieces of SLICE bytes at most, each with the bytes that filters read beyond it and the number
    of positions it stands for; in groups of about SLICE positions."""
    held, size = [], 0
    for t in texts:
        n = max(1, len(t))
        for a in range(0, n, SLICE):
            own = min(SLICE, n - a)
            if held and size + own > SLICE:
                yield held
                held, size = [], 0
            held.append((t[a : a + own + WIDTH - 1], own))
            size += own
    if held:
        yield held


def _grid(pieces: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces laid out one after the other, each followed by WIDTH - 1 zero bytes at least, so that no filter reads another text:
    bytes, which steps hold positions, and valid positions."""
    own = np.array([n for _, n in pieces])
    room = steps(own + WIDTH - 1)
    total = int(room.sum())
    flat, valid, real = np.zeros(total * STEP + WIDTH, np.uint8), np.zeros(total * STEP, bool), np.zeros(total, bool)
    at = 0
    for (t, n), k, full in zip(pieces, room.tolist(), steps(own).tolist(), strict=True):
        flat[at * STEP : at * STEP + len(t)] = t
        valid[at * STEP : at * STEP + n] = True
        real[at : at + full] = True
        at += k
    return flat, real, valid


def _conv(tables: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    n = len(flat) - WIDTH
    if len(tables) == WIDTH:  # by single taps
        out = tables[0].take(flat[:n], axis=0)
        for j, t in enumerate(tables[1:], 1):
            out += t.take(flat[j : j + n], axis=0)
        return out
    pair = flat[:-1].astype(np.intp)
    pair <<= 8
    pair |= flat[1:]
    out = tables[0].take(pair[:n], axis=0)
    for j, t in enumerate(tables[1:], 1):
        out += t.take(pair[2 * j : 2 * j + n], axis=0)
    return out


def _pool(tables: list[np.ndarray], texts: list[np.ndarray], winners: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Step maxima of all texts, steps of each text and, with winners, the bytes read and in them the place that won each maximum."""
    pooled, read, place, at = [], [], [], 0
    for group in _pieces(texts):
        flat, real, valid = _grid(group)
        act = _conv(tables, flat)
        act[~valid] = -np.inf
        act = act.reshape(-1, STEP, FILTERS)[real]
        if winners:
            where = act.argmax(axis=1)
            pooled.append(np.take_along_axis(act, where[:, None, :], 1)[:, 0])
            place.append(where + at + STEP * np.flatnonzero(real)[:, None])
            read.append(flat)
            at += len(flat)
        else:
            pooled.append(act.max(axis=1))
    none = np.zeros((0, FILTERS), np.intp)
    return np.vstack(pooled), steps(np.array([len(t) for t in texts])), np.concatenate(read or [np.zeros(0, np.uint8)]), np.vstack(place or [none])


def _chunks(pooled: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step maxima to chunk maxima (a step and the next one of the same text) and the first chunk of each text."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    later = np.vstack([pooled[1:], np.full((1, pooled.shape[1]), -np.inf, pooled.dtype)])
    later[np.cumsum(n) - 1] = -np.inf
    return np.maximum(pooled, later), first


def features(tables: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Mean and maximum over the chunks of each text of the rectified chunk maxima. A text's row depends on that text alone."""
    pooled, n, _, _ = _pool(tables, texts)
    chunk, first = _chunks(pooled, n)
    chunk = np.maximum(chunk, 0).astype(np.float64)
    return np.hstack([np.add.reduceat(chunk, first, axis=0) / n[:, None], np.maximum.reduceat(chunk, first, axis=0)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _crop(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A short piece of a text, cut at spaces where there are any."""
    size = int(2 ** rng.uniform(4, 9))
    start = int(rng.integers(0, max(1, len(text) - size)))
    part = text[start : start + size]
    space = np.flatnonzero(part == 32)
    return part[space[0] + 1 : space[-1]] if len(space) > 2 else part


def train(rows: list[tuple[str, int]], seed: int = 7) -> Net:
    """Fits the network; without two classes the score is the share of ones (1/2 without rows)."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1))
    y_all = np.array([float(y) for _, y in rows])
    share = y_all.mean() if len(rows) else 0.5
    net.shift[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if len(set(y_all)) < 2:
        return net
    net.out[:] = rng.normal(0, 0.1, 2 * FILTERS)
    data = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows]
    params = [net.embed, net.filters, net.bias, net.out, net.shift]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            texts = [_crop(data[i], rng) if y_all[i] and rng.random() < CROP else data[i] for i in pick]
            pooled, n, flat, where = _pool(net.taps(), texts, winners=True)
            chunk, first = _chunks(pooled, n)
            k = len(chunk)
            step = np.arange(k)[:, None] + (chunk > pooled)  # the step that won each chunk
            chunk = np.maximum(chunk, 0)
            doc = np.repeat(np.arange(len(n)), n)
            mean = np.add.reduceat(chunk, first, axis=0) / n[:, None]
            most = np.maximum.reduceat(chunk, first, axis=0)
            z = np.hstack([mean, most]) @ net.out + net.shift
            dz = (sigmoid(z) - y_all[pick]) / len(pick)
            d_chunk = (dz / n)[doc][:, None] * net.out[:FILTERS]
            won = (chunk == most[doc]) & (chunk > 0)
            ties = np.maximum(1, np.add.reduceat(won, first, axis=0, dtype=np.float64))
            d_chunk = (d_chunk + won / ties[doc] * dz[doc][:, None] * net.out[FILTERS:]) * (chunk > 0)
            # back to the byte positions that won
            f = np.broadcast_to(np.arange(FILTERS), (k, FILTERS)).ravel()
            s = step.ravel()
            at = where[s, f]
            g = d_chunk.ravel()
            live = g != 0
            f, at, g = f[live], at[live], g[live]
            d_embed, d_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
            for j in range(WIDTH):
                by_byte = np.bincount(flat[at + j].astype(np.intp) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS)  # gradient of the tap's table
                d_embed += by_byte @ net.filters[j].T
                d_filters[j] = net.embed.T @ by_byte
            grads = [d_embed, d_filters, np.bincount(f, g, FILTERS), np.hstack([mean, most]).T @ dz, np.array([dz.sum()])]
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for p, dp, mi, vi in zip(params, grads, m, v, strict=True):
                mi += 0.1 * (dp - mi)
                vi += 0.01 * (dp * dp - vi)
                p -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)
    return net


def score_texts(net: Net, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text, the same in any company: a text's sums run in an order of their own."""
    out = np.zeros(len(offsets) - 1)
    for a, b in common.slices(offsets, SLICE):
        x = features(tables, [data[offsets[i] : offsets[i + 1]] for i in range(a, b)])
        out[a:b] = sigmoid((x * net.out).sum(axis=1) + net.shift)
    return out


def _scores(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            scores = score_texts(net, tables, *common.string_buffers(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    return run


def score(df: DataFrame, net: Net, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns and score, from 0 to 1, of each row; a column of that name gives way to it. Null and empty texts have the
    score of a single zero byte; texts of any length are read whole, repeated rows are each scored."""
    kept = df.select(*[F.col(f"`{c}`") for c in columns if c.lower() != "score"], F.col(text_col).alias(common.fresh("content", columns)))
    return common.map_rows(kept, _scores(net), drop=1, score="double")


def _keep(net: Net, text: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(net, tables, *common.string_buffers(batch.column(text))) >= least))

    return run


def accepted(docs: DataFrame, net: Net, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score least or more, all columns as they are, whatever their names; each row by its own text alone."""
    return common.map_rows(docs, _keep(net, docs.columns.index(text_col), least))


def fit(spark: SparkSession, sf_dir: str, folds: int = 4, held_out: int = 2) -> Net:
    """Learns from a bounded sample of the labelled documents outside the held-out fold."""
    return train(labels.sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "quality", labels.fold("doc_id", folds) != held_out))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.table(spark, sf_dir, "documents"), fit(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", (labels.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad by even odds go."""
    net = train(labels.sample(docs, common.table(spark, sf_dir, "labels"), "quality", labels.fold("doc_id", 4) != 2))
    return accepted(docs, net)
