"""The stored vector index against all pairs."""

import numpy as np
import pytest

from lectern.operators.vector_index import Codes, VectorIndex


def exact(x, queries, k, floor):
    s = (x[queries] @ x.T).round(9)
    return {(int(queries[i]), int(j)): r + 1 for i in range(len(queries)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k]) if s[i, j] >= floor}


@pytest.mark.parametrize("kind", ["alike in all directions", "in groups"])
def test_recall_and_rows_scored(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 24))
    if kind == "in groups":
        x = rng.standard_normal((20, 24))[rng.integers(0, 20, 1500)] + 0.3 * x
    x[700:760] = x[700]  # a group of copies, which tie
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24)], "id long, vector array<double>").repartition(4)
    VectorIndex.write(base, str(tmp_path / "index"), 10)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert sorted(i for r in index.blocks.collect() for i in r.ids) == [*range(1500), 5001]
    queries = base.where("id % 50 = 0 and id < 1500").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id): (r.rank, r.score) for r in index.search(queries, 10, 0.1).collect()}
    want = exact(x, np.arange(0, 1500, 50), 10, 0.1)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(score - x[q] @ x[i]) < 1e-8 for (q, i), (_, score) in got.items())
    tally = index.search(queries, 10, 0.1, tally=True).collect()
    assert len(tally) == 30 and sum(r.scored for r in tally) < 0.6 * 30 * 1500 and all(r.scored <= r.reckoned for r in tally)


def test_codes_stand_near_their_rows():
    x = np.random.default_rng(1).standard_normal((600, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = Codes.fitted(x, 600, 5)
    again = Codes.of_row(*codes.row())
    own = (x @ codes.centres.T - (codes.centres**2).sum(axis=1) / 2).argmax(axis=1)
    near = np.concatenate([again.rows_of(c, again.codes_of(x[own == c], c)) for c in range(len(codes.centres))])
    assert np.abs(near - np.concatenate([x[own == c] for c in range(len(codes.centres))])).mean() < 0.05
    assert 1 <= codes.looks <= len(codes.centres) and codes.margin > 0


def test_nothing_to_search(spark, tmp_path):
    base = spark.createDataFrame([], "id long, vector array<double>")
    VectorIndex.write(base, str(tmp_path / "index"))
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.search(base.withColumnRenamed("id", "query_id"), 5, 0.0).count() == 0 and index.search(base.withColumnRenamed("id", "query_id"), 5, 0.0, tally=True).count() == 0
