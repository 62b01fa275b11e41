"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

From a unit vector v the products X v and X' u alternate over the distributed
rows X, each made orthogonal to all before it.  They leave a small bidiagonal
matrix; its singular vectors, carried back through the v's, are the principal
components, and its singular values over sqrt(n) their deviations.

A left vector u has an entry per row.  All of them lie in the range of X, so
u = X w is kept as the few numbers w and formed again inside each block.  A
step is one pass over the rows: a block forms its part of y = X (v - beta w),
of y's products with all former u's and of X' y.  As these are linear, y is made
orthogonal and normalised afterwards, on the sums alone.

All steps a dimension allows are taken: a Krylov space from one start holds one
vector per repeated deviation, and only a complete one misses none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

COMPONENTS = 16
SCALE = 64                    # a grid step is 1 / SCALE
BLOCK_VALUES = 1 << 18        # numbers in a block of rows
RANK = 1e-12                  # deviations below this share of the largest count as none
_BLOCK = "dim int, n long, kind string, data binary"


@dataclass
class Model:
    """What the distinct vectors of a table give; ``sums`` are of grid values."""

    n: int
    dim: int
    sums: np.ndarray          # per dimension, int64
    components: np.ndarray    # dim x k unit vectors
    deviations: np.ndarray    # k, of the grid values
    explained: np.ndarray     # k shares of the trace
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite entries."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def grid(rows: DataFrame, vector: str) -> Column:
    """floor(64 * c) of each entry as long: the contract's x without its offset, which centring takes away."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of an array column and the length of each row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()), np.diff(np.asarray(col.offsets))


def _pack(it):
    """Blocks of rows of one length, in the narrowest type that holds them."""
    def block(dim, rows):
        v = np.concatenate(rows)
        top = int(np.abs(v).max(initial=0))
        kind = next(k for k in ("int16", "int32", "int64") if top <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(v)], pa.int64()), pa.array([kind]),
             pa.array([v.astype(kind).tobytes()], pa.binary())], names=["dim", "n", "kind", "data"])

    held: dict[int, list] = {}
    for batch in it:
        values, lengths = _flat(batch.column("x"))
        ends = np.cumsum(lengths)
        for dim in np.unique(lengths).tolist():
            at = ends[lengths == dim] - dim
            rows = held.setdefault(dim, [])
            rows.append(values[at[:, None] + np.arange(dim)])
            if sum(map(len, rows)) * dim >= BLOCK_VALUES:
                yield block(dim, held.pop(dim))
    for dim, rows in held.items():
        yield block(dim, rows)


def _total(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all blocks of ``part(rows)``, a vector of one width: added up per task, then by place."""
    def run(it):
        total = None
        for batch in it:
            for k, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), k).reshape(-1, dim)
                new = part(x)
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["i", "value"])

    found = blocks.mapInArrow(run, f"i int, value {kind}").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found), np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r["i"]] = r["value"]
    return out


def _without(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` made orthogonal to the columns of ``basis``; twice is enough."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(blocks: DataFrame, dim: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): the right vectors of X - mean, and the bidiagonal matrix that they and the left ones leave.

    Where a product vanishes against the largest so far, its space is
    exhausted: the left vector is empty or the next right one is drawn anew,
    with a zero in B.
    """
    draw = np.random.default_rng(12)
    right, weights, back = np.zeros((dim, dim)), np.zeros((dim, dim)), np.zeros((dim, dim))
    matrix = np.zeros((dim, dim))
    beta, largest = 0.0, 0.0
    v = draw.standard_normal(dim)
    v /= np.linalg.norm(v)
    for j in range(dim):
        right[:, j] = v
        w = v - beta * weights[:, j - 1] if j else v
        former = weights[:, :j]

        def part(x, w=w, former=former):
            c = x - mean
            y = c @ w
            return np.concatenate(([y @ y], (c @ former).T @ y, c.T @ y))

        sums = _total(blocks, dim, part)
        along, product = sums[1:1 + j], sums[1 + j:]
        square = sums[0] - along @ along
        alpha = np.sqrt(max(square, 0.0))
        largest = max(largest, alpha, np.sqrt(max(sums[0], 0.0)))
        if alpha > RANK * largest:
            weights[:, j] = (w - former @ along) / alpha
            back[:, j] = (product - back[:, :j] @ along) / alpha
            matrix[j, j] = alpha
        if j + 1 == dim:
            break
        v = _without(back[:, j], right[:, :j + 1])
        beta = np.linalg.norm(v)
        if beta > RANK * largest:
            matrix[j, j + 1] = beta
        else:
            beta = 0.0
            v = _without(draw.standard_normal(dim), right[:, :j + 1])
        v /= np.linalg.norm(v)
    return right, matrix


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The whitening of a table's distinct grid vectors (see ``whiten``).

    Equal vectors are brought together before they move, so a vector that a
    third of all rows repeat costs no more than another.  The distinct ones are
    landed in packed blocks and read once per dimension.  The driver sees
    vectors and matrices of the dimension's size alone.
    """
    seen = rows.where(usable(F.col(vector))).select(grid(rows, vector).alias("x")).distinct()
    blocks = land(seen.mapInArrow(_pack, _BLOCK), "whitening-blocks")
    lengths = blocks.where("dim > 0").groupBy("dim").agg(F.sum("n").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return Model(0, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    dim, n = int(top["dim"]), int(top["n"])
    blocks = blocks.where(F.col("dim") == dim)
    sums = _total(blocks, dim, lambda x: x.sum(axis=0, dtype=np.int64), "long")
    mean = sums / n
    right, matrix = bidiagonalise(blocks, dim, mean)
    _, spread, turned = np.linalg.svd(matrix)
    k = min(components, int((spread > RANK * max(spread[0], np.finfo(float).tiny)).sum()))
    directions, deviations = (right @ turned.T)[:, :k], spread[:k] / np.sqrt(n)
    explained = spread[:k] ** 2 / max(float(spread @ spread), np.finfo(float).tiny)

    def second_moments(x):
        y = ((x - mean) @ directions) / deviations
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    error = 0.0
    if k:
        totals = _total(blocks, dim, second_moments) / n
        error = float(np.abs(totals[k:].reshape(k, k) - np.outer(totals[:k], totals[:k]) - np.eye(k)).max())
    return Model(n, dim, sums, directions, deviations, explained, error)


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums over dimensions of (n * x - S) ** 2."""
    top = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if top * top * max(x.shape[1], 1) < 1 << 62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]


def whiten(rows: DataFrame, model: Model, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of the rows that take part.

    ``whitened`` holds a row's centred grid vector along each component, over
    the component's deviation; ``deviation`` is the sum of (n * x - S) ** 2 over
    the dimensions, exact; one that a long cannot hold is an error.

    Vectors that are null or hold null or non-finite entries take no part, nor
    do those of another length than most distinct vectors have (of lengths
    equally frequent the greater).  Null ids stay; rows repeated, with their id
    or not, each have theirs.  Directions without spread are no components, so
    a table of one distinct vector has empty lists.  Empty tables give an empty
    result.  Only the two named columns are read.
    """
    def run(it):
        mean = model.mean
        for batch in it:
            values, lengths = _flat(batch.column("x"))
            x = values.reshape(len(lengths), model.dim)
            white = ((x - mean) @ model.components) / model.deviations
            k = white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(vec_id), pa.array(_squares(x, model.n, model.sums), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white.ravel()))],
                names=[vec_id, "deviation", "whitened"])

    kind = rows.schema[vec_id].dataType.simpleString()
    own = rows.where(usable(F.col(vector)) & (F.size(F.col(vector)) == model.dim) & F.lit(model.dim > 0))
    return own.select(vec_id, grid(rows, vector).alias("x")).mapInArrow(
        run, f"`{vec_id}` {kind}, deviation long, whitened array<double>")


def report(rows: DataFrame, model: Model, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``whiten`` with a row per component, numbered from 1: n, explained and the one identity_error beside it."""
    shares = F.array(*[F.lit(float(s)) for s in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    long = whiten(rows, model, vec_id, vector).select(vec_id, "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return long.select(vec_id, (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("p")).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))
