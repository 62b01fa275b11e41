"""Whitening against numpy's eigenvectors of the plainly computed covariance."""

import numpy as np
import pytest

from shelfgap.llm import whitening
from shelfgap.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16):
    """{component: (eigenvector, eigenvalue)}, x per row, n, S and the trace, by the contract's words."""
    xs = [(i, [int(np.floor(64 * float(c))) + 1000000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in xs}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return xs, n, sums, values[::-1], vectors[:, ::-1], np.trace(cov)


def compare(got, rows, components=16, rank=None):
    xs, n, sums, values, vectors, trace = brute(rows)
    k = min(components, rank if rank is not None else len(values))
    assert len(got) == len(xs) * k
    white = {}
    for r in got:
        white.setdefault(r["component"], []).append((r["vec_id"], r["whitened"], r["deviation"], r["explained"], r["n"]))
    assert sorted(white) == list(range(1, k + 1))
    exact = sorted((i, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))) for i, x in xs)
    for c in range(k):
        expected = sorted((i, (np.array(x) - sums / n) @ vectors[:, c] / np.sqrt(values[c])) for i, x in xs)
        own = sorted((i, w) for i, w, *_ in white[c + 1])
        a, b = np.array([w for _, w in own]), np.array([w for _, w in expected])
        flip = min((1, -1), key=lambda s: np.abs(np.sort(s * a) - np.sort(b)).max())
        assert np.abs(np.sort(flip * a) - np.sort(b)).max() < 1e-7
        assert sorted((i, d) for i, _, d, *_ in white[c + 1]) == exact
        assert all(abs(e / (values[c] / trace) - 1) < 1e-10 and m == n for *_, e, m in white[c + 1])
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
            if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    compare(op12_whitening(spark, sf).collect(), rows)


def test_awkward_rows(spark):
    pick = np.random.default_rng(1)
    good = [(i, [float(c) for c in pick.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    good += [(7, good[0][1]), (7, good[1][1]), (None, good[2][1])] + [(100 + i, good[3][1]) for i in range(50)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5),
           (204, [float("inf")] * 5), (205, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA)
    rows = rows.withColumnRenamed("label", "whitened").withColumn("x", rows["vec_id"]).withColumn("n", rows["vec_id"])
    got = whitening.report(rows, whitening.fit(rows)).collect()
    assert not {r["vec_id"] for r in got} & {i for i, _ in bad}
    named = [(i, v) for i, v in good if i is not None]
    assert len(got) == len(good) * 5
    xs, n, sums, values, vectors, trace = brute(good)
    assert {r["n"] for r in got} == {n}
    for r in got:
        if r["vec_id"] == 7:
            assert r["deviation"] in {sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)) for i, x in xs if i == 7}
    assert sum(r["vec_id"] == 7 for r in got) == 5 * sum(i == 7 for i, _ in named)


@pytest.mark.parametrize("values", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_spread_have_no_components(spark, values):
    rows = spark.createDataFrame([(i, v, 0) for i, v in values], SCHEMA)
    model = whitening.fit(rows)
    assert whitening.report(rows, model).count() == 0
    assert whitening.whiten(rows, model).count() == len(values)


def test_constant_and_dependent_dimensions(spark):
    pick = np.random.default_rng(2)
    base = pick.integers(-300, 300, size=(80, 3)) / 64
    rows = [(i, [float(a), float(b), 2.5, float(c), float(a) + float(b)]) for i, (a, b, c) in enumerate(base)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    compare(whitening.report(df, whitening.fit(df)).collect(), rows, rank=3)


def test_repeated_deviations_are_all_found(spark):
    axes = [[8.0 * s if i == j else 0.0 for j in range(6)] for i in range(6) for s in (-1, 1)]
    rows = [(i, v) for i, v in enumerate(axes)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    model = whitening.fit(df)
    assert len(model.deviations) == 6 and np.ptp(model.deviations) < 1e-9
    assert np.abs(model.components.T @ model.components - np.eye(6)).max() < 1e-12
    assert model.identity_error < 1e-10


def test_a_wide_spread_of_deviations(spark):
    pick = np.random.default_rng(3)
    scales = 10.0 ** np.linspace(4, 0, 12)
    rows = [(i, [float(np.float32(c)) for c in pick.normal(size=12) * scales]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    compare(whitening.report(df, whitening.fit(df)).collect(), rows)


def test_a_deviation_beyond_64_bits_is_an_error(spark):
    rows = [(i, [float(i) * 1e14, 0.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception):
        whitening.report(df, whitening.fit(df)).collect()
