"""Toxicity classifier on words, regularised by counterfactual swaps of identity terms.

A logistic regression over the presence of words and beginnings of words.  Its loss adds a penalty on
the squared change of the logit when an identity term of a labelled text is
swapped for another of its group, so that terms which name a group, but insult
nobody, get no weight of their own.  An identity term counts as the whole word
alone, without its beginnings, so that a swap exchanges all there is of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import is_held_out, text_or_empty

MAX_TRAINING_ROWS = 6_000    # bound of the labelled sample that is brought to the driver
MAX_WORDS = 4096
PREFIX_BYTES = (4, 5, 6, 7)   # beginnings of words that count as words: insults are inflected
MIN_ROWS_PER_WORD = 3
MIN_RATIO = 30.0             # a word that says nothing exceeds it once in 10 million
COUNTERFACTUAL_WEIGHT = 4.0
L2 = 1e-4
# fixed values: neutral names of groups; the terms of a line stand for each other
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "deaf", "blind"), ("old", "young"),
)


def _words(buf: np.ndarray, offsets: np.ndarray, prefixes: Sequence[int] = PREFIX_BYTES,
           whole: np.ndarray = np.empty(0, np.uint32)):
    """Sorted distinct 32-bit hashes of each document's words and of the words' prefixes.

    The words whose hashes are in ``whole`` have no prefixes.
    """
    starts, ends, _ = tk.word_spans(buf, offsets, tk.ALNUM)
    spans = tk.Spans(tk.LOWER[buf])
    hashes = (spans.hash(starts, ends) >> np.uint64(32)).astype(np.uint32)
    at, found = [starts], [hashes]
    cut = ~np.isin(hashes, whole)
    for k in prefixes:
        begin = starts[cut & (ends - starts > k)]
        at.append(begin)
        found.append((spans.hash(begin, begin + k) >> np.uint64(32)).astype(np.uint32))
    at, hashes = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    hashes = hashes[order]
    bounds = np.searchsorted(at[order], offsets)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(hashes[a:b])


def hash_words(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64)
    return np.array([h[0] for h in _words(buf, offsets, ())], np.uint32)


def _named(identity: Sequence[Sequence[str]]) -> np.ndarray:
    """Sorted distinct hashes of all identity terms."""
    return np.unique(np.concatenate([np.empty(0, np.uint32), *(hash_words(g) for g in identity)]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                  features: Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]], doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(label, x) of at most ``max_rows`` labelled documents that are not held out, chosen by hash.

    x holds the bytes of what ``features`` gives for the document's text; the
    texts stay where they are.  Rows without an id or a label 0 or 1 are
    ignored; of several labels of an id the larger counts; of rows with one id
    each is taken.
    """
    ids = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out("id"))
           .groupBy("id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    schema = pa.schema([("place", pa.int64()), ("tie", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def run(it):
        for batch in it:
            buf, off = tk.binary_parts(batch.column("text"))
            for a, b in tk.doc_chunks(off):
                rows = [x.tobytes() for x in features(buf[off[a]:off[b]], off[a:b + 1] - off[a])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a).cast(schema.field(c).type) for c in schema.names[:3]),
                     pa.array(rows, pa.binary())], schema=schema)

    # at most max_rows ids
    return (docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
            .join(F.broadcast(ids), "id")
            .select(F.xxhash64("id").alias("place"), F.xxhash64("text").alias("tie"), "label", "text")
            .mapInArrow(run, "place long, tie long, label int, x binary")
            .orderBy("place", "tie", "x").limit(max_rows).select("label", "x"))


class ToxicityModel:
    """Word hashes with weights, a bias, and the hashes of the words that count whole alone."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, whole: np.ndarray):
        order = np.argsort(words)
        self.words, self.weights, self.bias, self.whole = words[order], weights[order], float(bias), whole

    def logit(self, present: np.ndarray) -> float:
        """Logit of a text with these distinct words."""
        if not len(self.words):
            return self.bias
        at = np.searchsorted(self.words, present)
        at[at == len(self.words)] = 0
        return self.bias + float(self.weights[at[self.words[at] == present]].sum())


def fit_sets(sets: list[np.ndarray], labels: np.ndarray, identity: Sequence[Sequence[str]] = IDENTITY_TERMS,
             counterfactual_weight: float = COUNTERFACTUAL_WEIGHT, steps: int = 400) -> ToxicityModel:
    """Fit on word sets.  With one class only the model is its smoothed share; without rows it rejects nothing."""
    y = np.asarray(labels, np.float64)
    n, share = len(y), (float(np.sum(labels)) + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share))) if n else -np.inf
    groups, named = [hash_words(g) for g in identity], _named(identity)
    none = np.empty(0, np.uint32)
    if not n or y.min() == y.max():
        return ToxicityModel(none, np.empty(0), bias, named)
    words, rows_with = np.unique(np.concatenate([none, *sets]), return_counts=True)
    seen, times = np.unique(np.concatenate([none, *(x for x, bad in zip(sets, y) if bad)]), return_counts=True)
    toxic = np.zeros(len(words))
    toxic[np.searchsorted(words, seen)] = times
    clean = rows_with - toxic
    # likelihood ratio of "as toxic as the word's rows are" against "as toxic as all rows"
    rate, mean = toxic / rows_with, y.mean()
    ratio = 2 * (toxic * np.log(np.maximum(rate, 1e-12) / mean)
                 + clean * np.log(np.maximum(1 - rate, 1e-12) / (1 - mean)))
    strong = np.flatnonzero((rows_with >= MIN_ROWS_PER_WORD) & (ratio >= MIN_RATIO))
    strong = strong[np.argsort(-ratio[strong], kind="stable")][:MAX_WORDS]
    vocabulary = np.union1d(words[strong], named)
    del words, rows_with, seen, times, toxic, clean, rate, ratio
    d = len(vocabulary)
    if not d:
        return ToxicityModel(vocabulary, np.empty(0), bias, named)
    r, c = [], []
    for i, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at[at == d] = 0
        c.append(at[vocabulary[at] == s])
        r.append(np.full(len(c[-1]), i))
    r, c = np.concatenate(r), np.concatenate(c)
    # a swap takes one column out and puts another in
    out_col, in_col = [], []
    for g in groups:
        cols = np.searchsorted(vocabulary, g)
        for i in np.flatnonzero(np.isin(c, cols)):
            for other in cols[cols != c[i]]:
                out_col.append(c[i])
                in_col.append(other)
    out_col, in_col = np.array(out_col, np.int64), np.array(in_col, np.int64)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = bias
    for t in range(1, steps + 1):
        score = np.bincount(r, weights=w[c], minlength=n) + w[d]
        err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / n
        grad = np.bincount(c, weights=err[r], minlength=d + 1) + 2 * L2 * w
        grad[d] = err.sum()
        if len(out_col):
            change = (w[in_col] - w[out_col]) * 2 * counterfactual_weight / len(out_col)
            grad += np.bincount(in_col, weights=change, minlength=d + 1)
            grad -= np.bincount(out_col, weights=change, minlength=d + 1)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return ToxicityModel(vocabulary, w[:d], w[d], named)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS,
        doc_id: str = "doc_id", text: str = "text", identity: Sequence[Sequence[str]] = IDENTITY_TERMS,
        **options) -> ToxicityModel:
    """Fit on a bounded labelled sample, whose distinct word hashes come to the driver."""
    named = _named(identity)
    rows = training_rows(docs, labels, label, max_rows, lambda buf, offsets: _words(buf, offsets, whole=named),
                         doc_id, text).collect()
    sets = [np.frombuffer(r["x"], np.uint32) for r in rows]
    return fit_sets(sets, np.array([r["label"] for r in rows], np.float64), identity, **options)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted (1 from the threshold on).

    Every word of a text counts once, wherever it stands.  Null and empty texts
    get the model's base rate, as all texts do, about 0, if the model saw no label.  Repeated rows each get a row; an empty table
    gives an empty result.  Only the id and text columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))   # at most MAX_WORDS and the identity terms

    def run(it):
        m = ToxicityModel(**shared.value)
        for batch in it:
            buf, off = tk.binary_parts(batch.column("text"))
            z = np.empty(batch.num_rows)
            for a, b in tk.doc_chunks(off):
                for i, present in enumerate(_words(buf[off[a]:off[b]], off[a:b + 1] - off[a], whole=m.whole), a):
                    z[i] = m.logit(present)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        F.col("doc_id").alias(doc_id), is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
