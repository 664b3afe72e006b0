"""The inverted-file index and the clusters around leaders against plain passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import ivf, leaders


def table(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")


def plain(data, queries, k):
    x = data.astype(np.float32).astype(float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in queries:
        s = np.round(x @ x[q], 6)
        s[q] = -9
        out[q] = np.argsort(-s, kind="stable")[:k].tolist()
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((12, 32))
    data = np.concatenate([centre[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 32)), rng.standard_normal((1000, 32))])
    data[5], data[900] = 0, data[901]
    return data


@pytest.mark.parametrize("cell", [90, 4096])
def test_full_probing_is_exact(spark, cloud, cell):
    df = table(spark, cloud)
    got = {}
    for r in ivf.search(ivf.build(df, members=100, sample=1600), df.where("vec_id % 50 = 0"), 15, exact=True, cell=cell).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    assert got == plain(cloud, range(0, len(cloud), 50), 15)


def test_recall_of_probing(spark, cloud):
    df = table(spark, cloud)
    index = ivf.build(df, members=100, sample=1600)
    want = plain(cloud, range(0, len(cloud), 20), 10)
    hits = ivf.search(index, df.where("vec_id % 20 = 0"), 10).collect()
    assert sum(r.neighbour in want[r.query] for r in hits) / sum(map(len, want.values())) >= 0.9
    assert index.rows.count() == len(cloud) and index.rows.select("list").distinct().count() > 20


def test_names_and_empty_tables(spark):
    base = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "name string, embedding array<double>")
    items = spark.createDataFrame([(1, [2.0, 0.1])], "vec_id long, embedding array<double>")
    assert [(r.neighbour, r.rank) for r in ivf.search(ivf.build(base, "name"), items, 3, others=False, exact=True).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert ivf.search(ivf.build(base.limit(0), "name"), items, 3, others=False).collect() == []
    assert ivf.search(ivf.build(base, "name"), items.where(F.lit(False)), 3).collect() == []


def test_small_index_shuffles_no_query(spark, cloud):
    """An index of one cell is sent to the queries; the result is that of the cells, with repeated identifiers too."""
    base = table(spark, cloud).where("vec_id < 300")
    items = table(spark, cloud).union(table(spark, cloud).where("vec_id = 7").selectExpr("8L", "embedding"))
    index = ivf.build(base)
    for asked, others in ((items, False), (items.where("vec_id % 9 = 2"), True)):
        got, want = (ivf.search(index, asked, 4, exact=True, others=others, cell=c) for c in (4096, 100))
        assert sorted(map(tuple, got.select("query", "similarity", "rank").collect())) == sorted(map(tuple, want.select("query", "similarity", "rank").collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def sequential(rows, threshold):
    """(group, id, frequency, vector): the pass one after the other."""
    out = {}
    for g in {r[0] for r in rows}:
        lead = []
        for _, i, f, v in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            v = np.array(v) / max(np.linalg.norm(v), 1e-300)
            near = [name for name, u in lead if u @ v >= threshold - 1e-9]
            out[i] = near[0] if near else i
            if not near:
                lead.append((i, v))
    return out


@pytest.mark.parametrize("block", [5, 64, 2048])
def test_leaders_are_those_of_the_sequential_pass(spark, block):
    """One group holds most rows, others few; frequencies tie."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((9, 6))
    data = [("hot" if k % 10 else f"g{k % 3}", k, int(rng.integers(0, 6)), (centre[k % 9] + rng.standard_normal(6) * (0.2 if k % 4 else 2)).tolist()) for k in range(240)]
    df = spark.createDataFrame(data, "label string, vec_id long, n int, embedding array<double>").repartition(6)
    got = leaders.leader_clusters(df, "label", threshold=0.9, frequency=F.col("n"), block=block).collect()
    assert {r.id: r.cluster for r in got} == sequential(data, 0.9) and len(got) == len(data)
    often = {k: n for _, k, n, _ in data}
    for r in got:
        members = [x.id for x in got if x.cluster == r.cluster]
        assert r.size == len(members) and r.total == sum(often[i] for i in members)


def test_leaders_of_odd_rows(spark):
    data = [(None, 1, [1.0, 0.0]), (None, 2, [2.0, 0.0]), ("a", 3, None), ("a", 4, [0.0, 0.0]), ("a", 5, [0.0, 0.0])]
    df = spark.createDataFrame(data, "label string, vec_id long, embedding array<double>")
    assert sorted((r.id, r.cluster) for r in leaders.leader_clusters(df, "label").collect()) == [(1, 1), (2, 1), (4, 4), (5, 5)]
    assert leaders.leader_clusters(df.limit(0), "label").collect() == []
