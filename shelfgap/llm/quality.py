"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A word's vector is the sum of its neighbours' sparse random index vectors over
the whole corpus.  Words are hashed to a fixed number of rows, so the table has
one size whatever the corpus holds.  A document is pooled from its words' unit
vectors: their weighted mean, and the mean of the products, entry by entry, of
neighbours' vectors, which tells how its words follow one another.
Probabilities are calibrated by a temperature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import is_held_out, shuffle_partitions, text_or_empty
from .toxicity import training_rows

MAX_TRAINING_ROWS = 20_000   # bound of the labelled sample that is brought to the driver
ROWS = 1 << 14               # hashed words
DIM = 32
FEATURES = 2 * DIM           # the mean vector, and the mean product of neighbours
POOLED_AT_ONCE = 1 << 16     # neighbours whose vectors are held at once
NONZERO = 4                  # entries of an index vector, +1 or -1
WINDOW = 2                   # neighbours on either side
HIDDEN = 32
BLOCKS = 64                  # pieces in which the table is summed
FLUSH_TOKENS = 1 << 20
_COLUMN = (tk.mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(77)) % np.uint64(DIM)).astype(np.int64)
_SIGN = 1.0 - 2.0 * (tk.mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(7777)) & np.uint64(1)).astype(float)
_COLUMN, _SIGN = _COLUMN.reshape(ROWS, NONZERO), _SIGN.reshape(ROWS, NONZERO)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and runs of other signs, case kept, and each document's first."""
    hashes, bounds = tk.word_hashes(buf, offsets, tk.ALNUM_OR_SIGN, lower=False)
    return (hashes % np.uint64(ROWS)).astype(np.int64), bounds


class _Contexts:
    """Sums of neighbours' index vectors, and counts, of one task."""

    def __init__(self):
        self.sums, self.counts = np.zeros(ROWS * DIM), np.zeros(ROWS)

    def add(self, token: np.ndarray, bounds: np.ndarray):
        self.counts += np.bincount(token, minlength=ROWS)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for away in range(1, WINDOW + 1):
            one, two = token[:-away], token[away:]
            same = doc[:-away] == doc[away:]
            one, two = one[same], two[same]
            for word, near in ((one, two), (two, one)):
                for k in range(NONZERO):
                    self.sums += np.bincount(word * DIM + _COLUMN[near, k], weights=_SIGN[near, k],
                                             minlength=ROWS * DIM)


_TABLE = [("block", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary())]


def _accumulate(it):
    own, tokens, bounds, held = _Contexts(), [], [np.zeros(1, np.int64)], 0
    for batch in it:
        buf, off = tk.binary_parts(batch.column("text"))
        for a, b in tk.doc_chunks(off):
            t, e = _tokens(buf[off[a]:off[b]], off[a:b + 1] - off[a])
            tokens.append(t)
            bounds.append(e[1:] + held)
            held += len(t)
            if held >= FLUSH_TOKENS:
                own.add(np.concatenate(tokens), np.concatenate(bounds))
                tokens, bounds, held = [], [np.zeros(1, np.int64)], 0
    if held:
        own.add(np.concatenate(tokens), np.concatenate(bounds))
    if own.counts.any():
        sums = own.sums.reshape(BLOCKS, -1)
        counts = own.counts.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary()),
             pa.array([x.tobytes() for x in counts], pa.binary())], schema=pa.schema(_TABLE))


def _sum_blocks(it):
    total: dict[int, list[np.ndarray]] = {}
    for batch in it:
        for block, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            s, c = np.frombuffer(s), np.frombuffer(c)
            if block in total:
                total[block][0] += s
                total[block][1] += c
            else:
                total[block] = [s.copy(), c.copy()]
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(total, pa.int32()), pa.array([v[0].tobytes() for v in total.values()]),
             pa.array([v[1].tobytes() for v in total.values()])], schema=pa.schema(_TABLE))


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(ROWS x DIM unit vectors, ROWS weights) from all texts; the summed table, 4 MB, comes to the driver."""
    spec = "block int, sums binary, counts binary"
    parts = (docs.select(text_or_empty(text).alias("text")).mapInArrow(_accumulate, spec)
             .repartition(min(BLOCKS, shuffle_partitions(docs.sparkSession)), "block")
             .mapInArrow(_sum_blocks, spec).collect())
    vectors, counts = np.zeros((BLOCKS, ROWS // BLOCKS * DIM)), np.zeros((BLOCKS, ROWS // BLOCKS))
    for r in parts:
        vectors[r["block"]] = np.frombuffer(r["sums"])
        counts[r["block"]] = np.frombuffer(r["counts"])
    vectors, counts = vectors.reshape(ROWS, DIM), counts.ravel()
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    share = counts / max(counts.sum(), 1.0)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def _pool(buf, offsets, vectors, weights) -> np.ndarray:
    """Per document the weighted mean of its word vectors and the mean product of neighbours' vectors;
    zeros without words, and without neighbours."""
    token, bounds = _tokens(buf, offsets)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            count = np.bincount(token[a:b], minlength=0)
            seen = np.flatnonzero(count)
            mass = count[seen] * weights[seen]
            out[i, :DIM] = mass @ vectors[seen] / mass.sum()
        if b > a + 1:
            total = np.zeros(DIM)
            for k in range(a, b - 1, POOLED_AT_ONCE):
                own = vectors[token[k:min(k + POOLED_AT_ONCE, b - 1) + 1]]
                total += np.einsum("ij,ij->j", own[:-1], own[1:], dtype=np.float64)
            out[i, DIM:] = total / (b - a - 1)
    return out


class QualityModel:
    """Word table, network and temperature."""

    def __init__(self, vectors, weights, center, spread, w1, b1, w2, b2, temperature):
        self.vectors, self.weights, self.center, self.spread = vectors, weights, center, spread
        self.w1, self.b1, self.w2, self.b2, self.temperature = w1, b1, w2, b2, temperature

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.center) / self.spread
        return (np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7):
    """(center, spread, w1, b1, w2, b2, temperature); a fifth of the rows only sets the temperature."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    center = x.mean(axis=0) if n else np.zeros(d)
    spread = x.std(axis=0) + 1e-6 if n else np.ones(d)
    share = (float(y.sum()) + 0.5) / (n + 1)
    p = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN),
         np.array(np.log(share / (1 - share)))]
    if n < 10 or y.min() == y.max():
        return center, spread, *p, 1.0
    x = (x - center) / spread
    aside = rng.permutation(n)
    hold, train = aside[:n // 5], aside[n // 5:]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = epochs * -(-len(train) // 256)
    for _ in range(epochs):
        order = rng.permutation(train)
        for k in range(0, len(order), 256):
            i = order[k:k + 256]
            h = np.tanh(x[i] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [x[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum()]
            t += 1
            for j, g in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 0.01 * (1 - t / (steps + 1)) * (m[j] / (1 - 0.9 ** t)) / (
                    np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)
    z = np.tanh(x[hold] @ p[0] + p[1]) @ p[2] + p[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    temperature = float(min(grid, key=lambda s: _nll(z / s, y[hold])))
    return center, spread, *p, temperature


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS,
        doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Word vectors from all of ``docs``; network from a bounded labelled sample."""
    vectors, weights = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    rows = training_rows(docs, labels, label, max_rows, lambda buf, offsets: _pool(buf, offsets, *shared.value),
                         doc_id, text).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, FEATURES)
    return QualityModel(vectors, weights, *fit_network(x, np.array([r["label"] for r in rows], np.float64)))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted (1 from the threshold on).

    Null, empty and blank texts are a document without words, with the score
    the network gives a zero vector.  Repeated rows each get a row; an empty
    table gives an empty result.  Only the id and text columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(it):
        m = QualityModel(**shared.value)
        for batch in it:
            buf, off = tk.binary_parts(batch.column("text"))
            z = np.empty(batch.num_rows)
            for a, b in tk.doc_chunks(off):
                z[a:b] = m.logit(_pool(buf[off[a]:off[b]], off[a:b + 1] - off[a], m.vectors, m.weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        F.col("doc_id").alias(doc_id), is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
