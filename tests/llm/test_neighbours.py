"""Operator 13 against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import op13_neighbours as op

ROWS = "vec_id long, embedding array<float>, label int, score double, row string, rank int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0, "x", 1) for i, v in zip(ids, vectors, strict=True)], ROWS)


def plain(ids, vectors, k=20, every=20):
    """query -> [(id, score)] over float32 components, ties to the smaller identifier."""
    x = np.array(vectors, np.float32).astype(float)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = (x * x[q]).sum(axis=1)
            order = sorted((r for r in range(len(ids)) if r != q), key=lambda r: (-score[r], ids[r]))[:k]
            out.setdefault(ids[q], []).append([(ids[r], score[r]) for r in order])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in w[0]} & {i for _, i, _ in got.get(q, [])}) for q, w in want.items())
    return hits / sum(len(w[0]) for w in want.values())


@pytest.fixture(scope="module")
def cloud():
    """Clusters of many sizes and norms, and an isotropic rest."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((30, 48))
    near = centre[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 48))
    data = np.concatenate([near, rng.standard_normal((2000, 48)) * rng.uniform(0.3, 2, (2000, 1))]).astype(np.float32)
    return list(range(len(data))), data


def test_recall_and_scores(spark, cloud):
    ids, data = cloud
    got, want = found(op.neighbours(frame(spark, ids, data), F.col("vec_id") % 20 == 0, members=128, sample=2000)), plain(ids, data)
    assert recall(got, want) > 0.97
    x = data.astype(float)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(math.isclose(s, x[q] @ x[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in rows) and q not in [i for _, i, _ in rows]
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)


def test_exact_way(spark, cloud, monkeypatch):
    """All lists that may hold something better; cells of few members and queries change nothing."""
    ids, data = cloud
    monkeypatch.setattr(op, "CELL", 100)
    got = found(op.neighbours(frame(spark, ids, data), F.col("vec_id") % 50 == 0, exact=True, members=300, sample=2000))
    want = plain(ids, data, every=50)
    assert {q: [i for _, i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in w[0]] for q, w in want.items()}


def test_tables(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want = plain([r.vec_id for r in rows], [r.embedding for r in rows])
    assert recall(found(op.query(spark, small)), want) > 0.95


def test_groups_of_copies_and_ties(spark):
    """A third of all rows are one vector; identifiers repeat."""
    rng = np.random.default_rng(2)
    data = rng.standard_normal((900, 16)).astype(np.float32)
    data[::3] = data[0]
    ids = list(range(900))
    got, want = found(op.neighbours(frame(spark, ids, data), F.col("vec_id") % 20 == 0, members=64, sample=900, exact=True)), plain(ids, data)
    assert {q: [i for _, i, _ in r] for q, r in got.items()} == {q: [i for i, _ in w[0]] for q, w in want.items()}
    twice = frame(spark, [20, 20, 1], [[1, 0], [2, 0], [1, 1]])
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op.neighbours(twice, F.col("vec_id") % 20 == 0).collect())
    assert rows == [(20, 1, 1, 2.0), (20, 1, 20, 2.0), (20, 2, 1, 1.0), (20, 2, 20, 2.0)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 20, None, 40, 60]
    data = [[1, 2], [3, 4], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [], [-1, 1], [5, 5], [1, 2, 3], [0, 0]]
    got = found(op.neighbours(frame(spark, ids, data), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1, 11.0), (2, 20, 1.0)], 20: [(1, 0, 1.0), (2, 1, 1.0)]}
    assert op.neighbours(spark.createDataFrame([], ROWS), F.col("vec_id") % 20 == 0).collect() == []
    assert op.neighbours(frame(spark, [20], [[1, 1]]), F.col("vec_id") % 20 == 0).collect() == []


def test_tested_share():
    """The share is exceeded as seldom as said by random directions."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200_000, 64))
    part = np.cumsum(x * x, axis=1)
    for m, share in op.shares(64, 16, 0.002):
        assert 0.0015 < (part[:, m - 1] > share * part[:, -1]).mean() < 0.0025
    assert op.shares(64, 16, 0.0) == [(16, 1.0), (32, 1.0), (48, 1.0)]
    turn = op.rotation(7)
    assert np.allclose(turn @ turn.T, np.eye(7))
