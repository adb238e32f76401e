import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from innings_engine.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k=32):
    """(n, deviations, eigenvalues, eigenvectors, centred rows) with numpy and Python integers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, deviations, values[::-1][:k], axes[:, ::-1][:, :k], y


def check(rows, vectors, k=32):
    n, deviations, values, axes, y = brute(list(vectors.values()), k)
    place = {v: i for i, v in enumerate(vectors)}
    assert len(rows) == n * len(values) and {r.n for r in rows} == {n}
    got = np.empty((n, len(values)))
    for r in rows:
        assert r.deviation == deviations[place[r.vec_id]]
        assert r.explained == pytest.approx(values[r.component - 1] / (y ** 2).sum() * n, rel=1e-9)
        got[place[r.vec_id], r.component - 1] = r.whitened
    want = y @ axes / np.sqrt(values)
    want *= np.sign((want * got).sum(axis=0))
    assert np.allclose(got, want, atol=1e-8)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10
    assert np.abs(got.T @ got / n - np.eye(len(values))).max() < 1e-10


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    check(wh.whitened_vectors(table).collect(), vectors)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(c) for c in rng.normal(size=5)] for i in range(40)}
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0, 1.0]), (103, [float("-inf")] * 5), (104, []), (105, [1.0, 2.0])]
    table = spark.createDataFrame([*good.items(), *bad], SCHEMA).withColumn("x", F.lit("own")).withColumn("n", F.lit("own")).repartition(7)
    check(wh.whitened_vectors(table).collect(), good)


def test_repeated_rows_count_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0]), (2, [5.0, 1.0])]
    got = wh.whitened_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    got = wh.whitened_vectors(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_dependent_dimensions_are_not_returned(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    got = wh.whitened_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-10


def test_too_large_an_entry_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        wh.whitened_vectors(spark.createDataFrame([(1, [1e38]), (2, [0.0])], SCHEMA))


@pytest.mark.parametrize("make", [
    lambda r: np.diag([4.0, 4.0, 4.0, 1.0, 1.0, 0.5]),
    lambda r: (lambda q: q @ np.diag([9.0] * 5 + [3.0, 3.0 - 1e-9] + [1e-6] * 10) @ q.T)(np.linalg.qr(r.normal(size=(17, 17)))[0]),
    lambda r: np.cov(r.normal(size=(30, 80)) * np.logspace(3, -3, 30)[:, None]),
    lambda r: np.diag([2.0] * 20) + np.diag([1.0] * 19, 1) + np.diag([1.0] * 19, -1),
    lambda r: np.array([[3.0]]), lambda r: np.array([[2.0, 1.0], [1.0, 2.0]]),
])
def test_eigenpairs(make):
    v = make(np.random.default_rng(11))
    values, vectors = wh.leading_components(v, 12)
    want = np.linalg.eigvalsh(v)[::-1][:12]
    assert np.allclose(values, want[:len(values)], rtol=0, atol=1e-13 * want[0])
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
