"""The bidiagonal solver and whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.llm import whitening
from zonetide.llm.bidiagonal import bidiagonalised, dqds, right_singular

RANDOM = np.random.default_rng(3)


def rotation(n):
    return np.linalg.qr(RANDOM.normal(size=(n, n)))[0]


MATRICES = {
    "one": np.array([[3.0]]), "two": RANDOM.normal(size=(2, 2)), "many": np.triu(RANDOM.normal(size=(48, 48))),
    "zero": np.zeros((5, 5)), "unit": np.eye(9), "one row": np.vstack([np.ones((1, 4)), np.zeros((3, 4))]),
    "graded": np.linalg.qr(RANDOM.normal(size=(400, 24)) * np.logspace(0, -6, 24))[1],
    "rank 4": RANDOM.normal(size=(12, 4)) @ RANDOM.normal(size=(4, 12)),
    "equal values": rotation(12) @ np.diag([3.0] * 6 + [1.0] * 6) @ rotation(12),
    "close values": rotation(20) @ np.diag(1 + 1e-9 * np.arange(20)) @ rotation(20),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    a = MATRICES[name]
    values, vectors = right_singular(a)
    truth = np.linalg.svd(a, compute_uv=False) ** 2
    scale = max(truth[0], 1e-30)
    assert np.abs(values - truth).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-10
    assert np.abs(a.T @ a @ vectors - vectors * values).max() <= 1e-12 * scale


def test_bidiagonal_form():
    a = MATRICES["many"]
    diagonal, upper, v = bidiagonalised(a)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(b.T @ b, v.T @ a.T @ a @ v, atol=1e-11)


def test_small_values_are_as_accurate_as_large_ones():
    # Singular values of this matrix run over 30 powers of ten; its determinant is known.
    diagonal, upper = 10.0 ** -np.arange(0, 30, 2), 10.0 ** -np.arange(1, 29, 2)
    values = dqds(diagonal, upper)
    assert math.isclose(np.log10(values).sum(), 2 * np.log10(diagonal).sum(), rel_tol=1e-12)


def by_numpy(vectors, ids):
    """whitened (rows by component), deviation and explained of the vectors."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    white = (n * x - total) / n @ directions[:, order] / np.sqrt(values[order])
    return n, dict(zip(ids, ((n * x - total) ** 2).sum(axis=1).tolist(), strict=True)), white, values[order] / values.sum()


def test_agrees_with_numpy(spark):
    vectors = (RANDOM.normal(size=(300, 20)) * np.linspace(1, 4, 20)).tolist()
    vectors += vectors[:50]  # copies count once
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(24)
    found = whitening.whitened(rows).collect()
    n, deviation, white, explained = by_numpy(vectors, range(350))
    assert len(found) == 350 * 16 and {r.n for r in found} == {n}
    got = np.zeros((350, 16))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert max(r.identity_error for r in found) < 1e-10


def test_many_factors_are_reduced_in_rounds(spark):
    rows = spark.range(400).select(F.col("id").alias("x0")).select(
        F.array(*[F.floor(F.hash("x0", F.lit(i)) / 2.0 ** 20) + 0 for i in range(6)]).alias("x"))
    fit = whitening.fit(rows.repartition(50), 6)
    x = np.array([r.x for r in rows.collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert fit.n == 400 and np.allclose(fit.variances, values, rtol=1e-10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (None, [0.5, -2.0]), (2, [1.0, 0.5])]
    bad = [(5, None), (6, []), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [None, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0])]
    rows = spark.createDataFrame([(i, v, 1, "y") for i, v in sound + bad],
                                 "vec_id long, embedding array<double>, n int, x string").withColumn("_x", F.lit(2))
    found = whitening.whitened(rows).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [
        (0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {(r.n, r.x, r._x) for r in found} == {(3, "y", 2)}


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []


def test_components_without_deviation_are_left_out(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(rows).collect()} == {1}


def test_too_large_entries_raise(spark):
    rows = spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(rows).collect()
