"""Nearest neighbours by inner product: a block matrix join on int8 products with error bounds.

Vectors are packed into blocks.  A tile is a block of queries against a block
of candidates: the product of their int8 forms gives every inner product up to
an error bounded by the lengths of the rounding residuals.  Only pairs whose
upper bound reaches what a query's k best are known to have are computed again
from the original components, in double precision; bounded heaps merge tiles,
tasks and passes.  Nothing that could be among the k best is dropped, so the
result is exact.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, shared_folder, shuffle_partitions

K = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
PASS_BYTES = 32 << 20        # of packed queries that are broadcast at once
PAIRS_AT_ONCE = 50_000
EXACT_DIMS = 1040            # products of so many int8 pairs are exact in a float's 24 bits
BLOCKS = "dim int, ids binary, first binary, vectors binary"
_BLOCK_SCHEMA = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("first", pa.binary()), ("vectors", pa.binary())])


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _clean(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v"))))


def _candidates(rows: DataFrame) -> DataFrame:
    """All rows, each of those repeated whole too; ``first`` marks one of those that share id and vector.

    A query leaves out the first row of its own id and vector, and only that.
    """
    counted = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        "vec_id", "v", (F.col("copy") == 1).alias("first"))


def _pack(size: int, keep: int | None):
    """Blocks of one dimension; with ``keep``, of equal vectors only the ``keep`` smallest ids.

    Equal vectors have equal scores, and ties go to smaller ids, so a copy
    beyond the ``keep`` smallest of its block is never among the nearest.
    """
    def block(dim, ids, first, parts):
        ids, first, v = np.array(ids, np.int64), np.array(first, bool), np.concatenate(parts).reshape(-1, dim)
        if keep:
            order = np.lexsort((~first, ids))
            ids, first, v = ids[order], first[order], v[order]
            same = np.unique(v, axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            start = np.searchsorted(same[order], same[order])
            order = np.sort(order[np.arange(len(ids)) - start < keep])
            ids, first, v = ids[order], first[order], v[order]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]),
                                           pa.array([first.tobytes()]), pa.array([v.tobytes()])], schema=_BLOCK_SCHEMA)

    def run(it):
        held: dict[int, tuple[list, list, list]] = {}
        for batch in it:
            col = batch.column("v")
            values = np.asarray(col.flatten())
            ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(col)))))
            flags = batch.column("first").to_pylist()
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                dim = int(ends[i + 1] - ends[i])
                ids, first, parts = held.setdefault(dim, ([], [], []))
                ids.append(vec_id)
                first.append(flags[i])
                parts.append(values[ends[i]:ends[i + 1]])
                if len(ids) >= size:
                    yield block(dim, *held.pop(dim))
        for dim, lists in held.items():
            yield block(dim, *lists)
    return run


class _Side:
    """A block with its int8 form: x = scale * q + residual."""

    def __init__(self, dim: int, ids: bytes, first: bytes, vectors: bytes):
        self.ids, self.first = np.frombuffer(ids, np.int64), np.frombuffer(first, bool)
        self.v = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        top = np.abs(self.v).max(axis=1)
        self.scale = np.maximum(top / 127.0, np.finfo(np.float64).tiny)
        self.q = np.rint(self.v / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.length = np.sqrt((near * near).sum(axis=1))
        rest = self.v - near
        self.rest = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9)


def _products(a: _Side, b: _Side) -> np.ndarray:
    """Integer products of the int8 forms: float matrix products, exact up to EXACT_DIMS columns each."""
    out = np.zeros((len(a.ids), len(b.ids)))
    for k in range(0, a.q.shape[1], EXACT_DIMS):
        out += a.q[:, k:k + EXACT_DIMS].astype(np.float32) @ b.q[:, k:k + EXACT_DIMS].astype(np.float32).T
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class _Heaps:
    """The k best (score, id) of each of n queries: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def push(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray):
        touched = np.unique(row)
        all_rows = np.concatenate((np.repeat(touched, self.k), row))
        all_scores = np.concatenate((self.scores[touched].ravel(), score))
        all_ids = np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows = all_rows[order]
        place = np.arange(len(order)) - np.searchsorted(all_rows, all_rows)
        best = order[place < self.k]
        self.scores[touched] = all_scores[best].reshape(-1, self.k)
        self.ids[touched] = all_ids[best].reshape(-1, self.k)


def _tile(a: _Side, b: _Side, heaps: _Heaps):
    """Merge a tile into the heaps."""
    near = _products(a, b) * a.scale[:, None] * b.scale[None, :]
    error = a.length[:, None] * b.rest[None, :] + a.rest[:, None] * (b.length + b.rest)[None, :]
    error += 1e-12 * (a.length + a.rest)[:, None] * (b.length + b.rest)[None, :]
    row, col = np.nonzero((a.ids[:, None] == b.ids[None, :]) & b.first[None, :])
    same = (a.v[row] == b.v[col]).all(axis=1)
    own = row[same], col[same]
    near[own] = -np.inf
    lower = near - error
    known = heaps.floor()
    if lower.shape[1] > heaps.k:
        known = np.maximum(known, np.partition(lower, -heaps.k, axis=1)[:, -heaps.k])
    del lower
    near += error
    near[own] = -np.inf
    row, col = np.nonzero((near >= known[:, None]) & (near > -np.inf))
    for i in range(0, len(row), PAIRS_AT_ONCE):
        r, c = row[i:i + PAIRS_AT_ONCE], col[i:i + PAIRS_AT_ONCE]
        heaps.push(r, inner(a.v[r], b.v[c]), b.ids[c])


FOUND = "query_id long, rank int, vec_id long, score double"
HEAPS = "part long, query_ids binary, scores binary, ids binary"


def _join(k: int):
    """Tiles to one heap per query of this task; a row per query block."""
    schema = pa.schema([("part", pa.int64()), ("query_ids", pa.binary()), ("scores", pa.binary()),
                        ("ids", pa.binary())])

    def run(it):
        heaps: dict[int, tuple[np.ndarray, _Heaps]] = {}
        last, side = None, None
        for batch in it:
            for r in range(batch.num_rows):
                dim, ids, first, vectors, part, q_ids, q_first, q_vectors = (batch.column(i)[r].as_py() for i in range(8))
                if (ids, first) != last:
                    last, side = (ids, first), _Side(dim, ids, first, vectors)
                queries = _Side(dim, q_ids, q_first, q_vectors)
                if part not in heaps:
                    heaps[part] = (queries.ids, _Heaps(len(queries.ids), k))
                _tile(queries, side, heaps[part][1])
        for part, (query_ids, h) in heaps.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([query_ids.tobytes()]), pa.array([h.scores.tobytes()]),
                pa.array([h.ids.tobytes()])], schema=schema)
    return run


def _merge(k: int):
    """Heaps of a query block from all tasks to ranked rows."""
    def run(it):
        total: dict[int, tuple[np.ndarray, _Heaps]] = {}
        for batch in it:
            for r in range(batch.num_rows):
                part, query_ids, scores, ids = (batch.column(i)[r].as_py() for i in range(4))
                query_ids = np.frombuffer(query_ids, np.int64)
                n = len(query_ids)
                if part not in total:
                    total[part] = (query_ids, _Heaps(n, k))
                scores, ids = np.frombuffer(scores, np.float64), np.frombuffer(ids, np.int64)
                found = np.isfinite(scores)
                total[part][1].push(np.repeat(np.arange(n), k)[found], scores[found], ids[found])
        for query_ids, h in total.values():
            found = np.isfinite(h.scores)
            rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), h.scores.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, found.sum(axis=1))), pa.array(rank[found]), pa.array(h.ids[found]),
                 pa.array(h.scores[found])], names=["query_id", "rank", "vec_id", "score"])
    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by inner product.

    All rows are candidates but the query's own, that is one row of its id and
    vector: rows that share the id with another vector count, and so do further
    copies of the row.  Of rows with one query id the least vector asks.  Ties
    go to the smaller id; fewer than k candidates give fewer rows.  Vectors that
    are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; vectors of different length do not meet.  Empty tables
    give an empty result.  Only the two named columns are read.

    Packed queries are broadcast in passes of PASS_BYTES, each landed in one
    folder, so the broadcast and the plan keep their size however many there
    are; candidates are read once a pass.
    """
    spark = candidates.sparkSession

    def packed(rows: DataFrame, size: int, keep: int | None) -> DataFrame:
        n = rows.count()
        return rows.repartition(max(1, -(-n // size))).mapInArrow(_pack(size, keep), BLOCKS)

    blocks = land(packed(_candidates(_clean(candidates, vec_id, vector)), CANDIDATE_BLOCK, k + 1), "ann-blocks")
    asking = _clean(queries, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"), F.lit(True).alias("first"))
    asked = land(packed(asking, QUERY_BLOCK, None).withColumn("part", F.monotonically_increasing_id()),
                 "ann-queries")
    size = asked.agg(F.sum(F.length("vectors")).alias("s")).first()["s"]
    passes = max(1, -(-int(size or 0) // PASS_BYTES))
    path = f"{shared_folder(spark)}/llm-ann-found-{uuid.uuid4().hex}"
    for i in range(passes):
        own = (asked.where(F.pmod(F.xxhash64("part"), F.lit(passes)) == i)
               .select("dim", "part", F.col("ids").alias("q_ids"), F.col("first").alias("q_first"),
                       F.col("vectors").alias("q_vectors")))
        tiles = (blocks.join(F.broadcast(own), "dim")     # about PASS_BYTES
                 .select("dim", "ids", "first", "vectors", "part", "q_ids", "q_first", "q_vectors"))
        heaps = tiles.mapInArrow(_join(k), HEAPS).repartition(shuffle_partitions(spark), "part")
        heaps.mapInArrow(_merge(k), FOUND).write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)
