import numpy as np
import pytest

from lectern.llm import whitening
from lectern.llm.whitening import whiten


def rows_of(vectors):
    return [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]


def compare(got, vectors, components=8):
    """The result against covariance by numpy: exact deviations, components up to sign, unit covariance."""
    x = np.array(rows_of(vectors), object)
    n, sums = len(x), x.sum(axis=0)
    centred = x.astype(float) - np.array([s / n for s in sums])
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1], c[:, ::-1]
    held = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * held and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(held):
        own = [by[i, k + 1] for i in range(n)]
        assert [r.deviation for r in own] == [int(((n * row - sums) ** 2).sum()) for row in x]
        want = centred @ c[:, k] / np.sqrt(e[k])
        w = np.array([r.whitened for r in own])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-7 * max(1, np.abs(want).max())
        assert abs(own[0].explained - e[k] / e.sum()) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8


@pytest.mark.parametrize("full", [256, 3])
def test_components_equal_eigenvectors(spark, full, monkeypatch):
    monkeypatch.setattr(whitening, "FULL", full)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + rng.standard_normal(12)
    frame = spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string").repartition(5)
    compare(whiten(frame).collect(), vectors.astype(np.float32).astype(float))


def test_rows_that_are_dropped_and_low_rank(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(a), float(b), float(a), 0.5] for a, b in rng.standard_normal((40, 2))]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [0.0, float("inf"), 0.0, 0.0]), (104, [1.0]), (105, [])]
    frame = spark.createDataFrame([*enumerate(vectors), *odd], "vec_id long, embedding array<double>")
    got = whiten(frame).collect()
    assert {r.component for r in got} == {1, 2}
    compare(got, vectors)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).count() == 0


def test_ties_of_deviations_give_an_orthonormal_basis(spark):
    vectors = [[float(a), float(b), 0.0] for a in (-1, 1) for b in (-1, 1)] * 3
    got = whiten(spark.createDataFrame([*enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-12
    assert all(abs(r.explained - 0.5) < 1e-12 for r in got)
