"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a learned vector for the word (a shared one for words outside the vocabulary) and the mean of learned
vectors of its bytes. Windows of WINDOW words that start every STRIDE words cover the whole text; each is read in both
directions, its states are pooled by attention, and one unit scores the pooled state. The score of a text is that of its
most toxic window. In training the gradient goes through that window.

A window is a fixed number of steps for all windows of a slice at once; the input side of the gates is computed once for each
distinct word of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labels
from .common import Words

WINDOW, STRIDE = 24, 12
HIDDEN, WORD, CHAR = 8, 6, 4
LEAST_DOCS = 3
"""Words of the vocabulary: those in so many fitted texts at least; all others share a vector, beside that of their bytes."""
EPOCHS, BATCH, RATE = 12, 64, 0.01
SLICE = 1 << 19
"""Bytes of text worked on at a time."""

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Net:
    vocabulary: np.ndarray  # sorted word hashes; row i + 1 of word is that of vocabulary[i], row 0 stands for all others
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring needs, in single precision."""
        p, out = self.p, {}
        for d in "fb":
            out[f"word_{d}"] = (p["word"] @ p[f"in_{d}"][:WORD] + p[f"bias_{d}"]).astype(np.float32)
            out[f"char_{d}"] = p[f"in_{d}"][WORD:].astype(np.float32)
            out[f"rec_{d}"] = p[f"rec_{d}"].astype(np.float32)
        return out | {k: p[k].astype(np.float32) for k in ("char", "att", "att_v", "out", "shift")}


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return common.split_sliced(data, offsets, SEPARATORS, SLICE)


def ids_of(vocabulary: np.ndarray, words: Words) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(words.hash), np.intp)
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words.hash, at + 1, 0)


def distinct(words: Words) -> tuple[Words, np.ndarray]:
    """The distinct words, laid out one after the other, and for each word which of them it is."""
    held, at, index = np.unique(words.hash, return_index=True, return_inverse=True)
    length = words.end[at] - words.start[at]
    end = np.cumsum(length)
    place = np.repeat(words.start[at] - end + length, length) + np.arange(int(length.sum()))
    return Words(words.data[place], end - length, end, held, np.array([0, len(at)])), index.ravel()


def char_means(char: np.ndarray, words: Words, most: int = 50_000) -> np.ndarray:
    """Mean of the byte vectors of each word, so many words at a time; words are in order of place."""
    out = np.zeros((len(words.start), char.shape[1]), char.dtype)
    for a in range(0, len(out), most):
        start, end = words.start[a : a + most], words.end[a : a + most]
        edges = np.empty(2 * len(start), np.int64)
        edges[::2], edges[1::2] = start - start[0], end - start[0]
        vectors = char[np.append(words.data[start[0] : end[-1]], 0)]
        out[a : a + most] = np.add.reduceat(vectors, edges, axis=0)[::2] / (end - start)[:, None].astype(char.dtype)
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts with words first[i]..first[i+1]: word index of each window's positions (WINDOW, windows), whether it is
    there, and the first window of each text. A text without words has one empty window."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = first[doc] + STRIDE * (np.arange(begin[-1]) - begin[doc])
    at = start[None, :] + np.arange(WINDOW)[:, None]
    there = at < first[doc + 1][None, :]
    return np.where(there, at, 0), there, begin[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _direction(gates: np.ndarray, there: np.ndarray, rec: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (WINDOW, windows, HIDDEN). gates: the input side, (WINDOW, windows, 3 * HIDDEN)."""
    h = np.zeros((gates.shape[1], HIDDEN), gates.dtype)
    out = np.empty((*gates.shape[:2], HIDDEN), gates.dtype)
    for t in reversed(range(WINDOW)) if back else range(WINDOW):
        side = h @ rec
        g = gates[t]
        rz = _sigmoid(g[:, : 2 * HIDDEN] + side[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * side[:, 2 * HIDDEN :])
        on = there[t][:, None]
        if keep is not None:
            keep.append((t, h, r, z, new, side[:, 2 * HIDDEN :]))
        h = np.where(on, new + z * (h - new), h)
        out[t] = h
    return out


def _pooled(states: np.ndarray, there: np.ndarray, att: np.ndarray, att_v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights, pooled states and the attention's hidden layer."""
    hid = np.tanh(states @ att)
    e = np.where(there, hid @ att_v, np.asarray(-30, states.dtype))
    e = np.exp(e - e.max(axis=0))
    e *= there
    a = e / np.maximum(e.sum(axis=0), np.asarray(1e-30, states.dtype))
    return a, np.einsum("tb,tbh->bh", a, states), hid


def gate_tables(t: dict[str, np.ndarray], vocabulary: np.ndarray, own: Words) -> dict[str, np.ndarray]:
    """For each direction the input side of the gates by distinct word; one row of zeros where there are none."""
    if not len(own.start):
        return {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
    ids, chars = ids_of(vocabulary, own), char_means(t["char"], own)
    return {d: t[f"word_{d}"][ids] + chars @ t[f"char_{d}"] for d in "fb"}


def all_logits(t: dict[str, np.ndarray], gates: dict[str, np.ndarray], index: np.ndarray, at: np.ndarray, there: np.ndarray, most: int = 2048) -> np.ndarray:
    """Of any number of windows, a bounded number at a time; index: the row of the gate tables of each word."""
    out = []
    for w in range(0, at.shape[1], most):
        on = there[:, w : w + most]
        own = index[at[:, w : w + most]] if len(index) else np.zeros(on.shape, np.intp)
        states = np.concatenate([_direction(gates[d][own], on, t[f"rec_{d}"], d == "b") for d in "fb"], axis=2)
        out.append(_pooled(states, on, t["att"], t["att_v"])[1] @ t["out"] + t["shift"])
    return np.concatenate(out)


def _gradients(p: dict[str, np.ndarray], ids: np.ndarray, chars: np.ndarray, words: Words, at: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the given windows, one for each text."""
    x = np.concatenate([p["word"][ids[at]], chars[at]], axis=2) * there[:, :, None] if len(ids) else np.zeros((*at.shape, WORD + CHAR))
    kept: dict[str, list] = {"f": [], "b": []}
    s = np.concatenate([_direction(x @ p[f"in_{d}"] + p[f"bias_{d}"], there, p[f"rec_{d}"], d == "b", kept[d]) for d in "fb"], axis=2)
    a, pooled, hid = _pooled(s, there, p["att"], p["att_v"])
    dz = (_sigmoid(pooled @ p["out"] + p["shift"]) - y) / len(y)
    g = {"out": pooled.T @ dz, "shift": np.array([dz.sum()])}
    d_pooled = dz[:, None] * p["out"]
    ds = a[:, :, None] * d_pooled[None]
    da = np.einsum("bh,tbh->tb", d_pooled, s)
    de = a * (da - (a * da).sum(axis=0))
    g["att_v"] = np.einsum("tb,tbk->k", de, hid)
    d_hid = de[:, :, None] * p["att_v"] * (1 - hid**2)
    g["att"] = np.einsum("tbh,tbk->hk", s, d_hid)
    ds = ds + d_hid @ p["att"].T
    dx = np.zeros_like(x)
    for i, d in enumerate("fb"):
        w_in, rec = p[f"in_{d}"], p[f"rec_{d}"]
        g[f"in_{d}"], g[f"rec_{d}"], g[f"bias_{d}"] = np.zeros_like(w_in), np.zeros_like(rec), np.zeros_like(p[f"bias_{d}"])
        dh = np.zeros((len(y), HIDDEN))
        for t, h, r, z, new, side in reversed(kept[d]):
            dh = dh + ds[t][:, i * HIDDEN : (i + 1) * HIDDEN]
            on = there[t][:, None]
            d_on = dh * on
            d_new = d_on * (1 - z) * (1 - new**2)
            d_z = d_on * (h - new) * z * (1 - z)
            d_r = d_new * side * r * (1 - r)
            d_gate = np.hstack([d_r, d_z, d_new])
            d_side = np.hstack([d_r, d_z, d_new * r])
            g[f"in_{d}"] += x[t].T @ d_gate
            g[f"bias_{d}"] += d_gate.sum(axis=0)
            g[f"rec_{d}"] += h.T @ d_side
            dx[t] += d_gate @ w_in.T
            dh = dh * ~on + d_on * z + d_side @ rec.T
    on = there.ravel()
    flat, own = dx.reshape(-1, WORD + CHAR)[on], at.ravel()[on]
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], ids[own], flat[:, :WORD])
    g["char"] = np.zeros_like(p["char"])
    length = (words.end - words.start)[own]
    place = np.repeat(words.start[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    np.add.at(g["char"], words.data[place], np.repeat(flat[:, WORD:] / length[:, None], length, axis=0))
    return g


def _vocabulary(words: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary and, for each, the smoothed log odds of the texts that hold it."""
    doc = np.repeat(np.arange(len(y)), np.diff(words.first))
    order = np.lexsort((doc, words.hash))
    held, doc = words.hash[order], doc[order]
    new = np.concatenate([[True], (held[1:] != held[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    vocab, index, count = np.unique(held[new], return_inverse=True, return_counts=True)
    ones = np.bincount(index, y[doc[new]], len(vocab))
    keep = np.flatnonzero(count >= LEAST_DOCS)
    share = y.mean()
    odds = np.log((ones[keep] + 2 * share) / (count[keep] - ones[keep] + 2 * (1 - share))) - np.log(share / (1 - share))
    return vocab[keep], odds


def train(rows: list[tuple[str, int]], seed: int = 11) -> Net:
    """Fits the network; without two classes the score is about the share of ones (1/2 without rows)."""
    rng = np.random.default_rng(seed)
    y = np.array([float(v) for _, v in rows])
    share = y.mean() if len(rows) else 0.5
    data, offsets = common.string_buffers(pa.array([t for t, _ in rows], pa.string()))
    words = words_of(data, offsets)
    vocabulary, odds = _vocabulary(words, y) if len(set(y)) == 2 else (np.zeros(0, np.uint64), np.zeros(0))
    p = {"word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD)), "char": rng.normal(0, 0.3, (256, CHAR)), "att": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "att_v": rng.normal(0, 0.3, HIDDEN), "out": np.zeros(2 * HIDDEN), "shift": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))])}
    for d in "fb":
        p |= {f"in_{d}": rng.normal(0, 0.3, (WORD + CHAR, 3 * HIDDEN)), f"rec_{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"bias_{d}": np.zeros(3 * HIDDEN)}
    net = Net(vocabulary, p)
    if len(set(y)) < 2:
        return net
    p["word"][0, 0] = 0
    p["word"][1:, 0] = odds
    p["out"][:] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["shift"][0] = -1
    ids = ids_of(vocabulary, words)
    own, index = distinct(words)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    at, there, begin = windows(words.first)
    for epoch in range(EPOCHS):
        if epoch < 3 or epoch % 3 == 0:  # the most toxic window of each text, by the net as it stands; later ones change little
            tables = net.tables()
            logits = all_logits(tables, gate_tables(tables, vocabulary, own), index, at, there)
            best = np.array([b + np.argmax(logits[b:e]) for b, e in zip(begin, [*begin[1:], len(logits)], strict=True)])
        chars = char_means(p["char"], own)[index]  # as of the epoch's start
        order = rng.permutation(len(y))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            g = _gradients(p, ids, chars, words, at[:, best[pick]], there[:, best[pick]], y[pick])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def score_texts(net: Net, tables: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for a, b in common.slices(offsets, SLICE):
        words = words_of(data, offsets[a : b + 1])
        at, there, begin = windows(words.first)
        own, index = distinct(words)
        logits = all_logits(tables, gate_tables(tables, net.vocabulary, own), index, at, there)
        out[a:b] = _sigmoid(np.maximum.reduceat(logits, begin).astype(np.float64))
    return out


def _scores(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            scores = score_texts(net, tables, *common.string_buffers(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    return run


def score(df: DataFrame, net: Net, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns and score, from 0 to 1, of each row; a column of that name gives way to it. Null and empty texts, and
    those without words, have the score of an empty window; texts of any length are read whole, repeated rows are each scored."""
    kept = df.select(*[F.col(f"`{c}`") for c in columns if c.lower() != "score"], F.col(text_col).alias(common.fresh("content", columns)))
    return common.map_rows(kept, _scores(net), drop=1, score="double")


def fit(spark: SparkSession, sf_dir: str, folds: int = 5, held_out: int = 0) -> Net:
    """Learns from a bounded sample of the labelled documents outside the held-out fold."""
    return train(labels.sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "toxic", labels.fold("doc_id", folds) != held_out))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.table(spark, sf_dir, "documents"), fit(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", (labels.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
