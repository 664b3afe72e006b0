"""Several runs over the same items, against plain passes."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import stability


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_nsi(rows, shifts, seed=42):
    place = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), str(r[0]).rjust(24, "0"))
    rows = sorted(rows, key=place)
    n = len(rows)
    if n < 2:
        return 0.0
    sets = [(set(a or ()), set(b or ())) for _, a, b in rows]
    o = sum(jaccard(a, b) for a, b in sets) / n
    steps = min(shifts, n - 1)
    r = sum(jaccard(sets[i][0], sets[(i + s) % n][1]) for i in range(n) for s in range(1, steps + 1)) / (n * steps)
    return 1.0 if r >= 1 else 0.0 if r >= o else (o - r) / (1 - r)


@pytest.mark.parametrize("n,block", [(0, 8), (1, 8), (2, 8), (17, 8), (150, 16), (150, 4096)])
def test_nsi(spark, n, block):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        a = rng.sample("abcdefghij", rng.randint(0, 5))
        rows.append((i, a if i % 7 else None, sorted({*a, rng.choice("xyz")})))
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").repartition(5)
    got = stability.nsi(df, shifts=20, block=block).first()
    assert got.items == n and got.nsi == pytest.approx(plain_nsi(rows, 20), abs=1e-6)


RUNS = "item long, run long, subdomains array<string>, terms array<string>, confidence double, is_valid boolean"


def test_pairs_metrics_and_means(spark):
    rows = [(1, 0, ["a"], ["x", "y"], 0.5, True), (1, 1, ["b"], ["x"], 0.7, True), (1, 2, [], [], 0.1, False), (2, 0, [], [], 0.2, True), (2, 1, [], [], 0.4, True), (3, 2, ["a"], ["x"], 1.0, True)]
    pairs = stability.run_pairs(spark.createDataFrame(rows, RUNS))
    assert sorted((r.item, r.run_a, r.run_b) for r in pairs.collect()) == [(1, *p) for p in itertools.combinations(range(3), 2)] + [(2, 0, 1)]
    agreed = stability.pair_agreement(pairs, F.create_map(F.lit("a"), F.lit("p"), F.lit("b"), F.lit("p")), soft=True)
    one = {(r.item, r.run_a, r.run_b): r for r in agreed.collect()}
    assert (one[1, 0, 1].raw_jaccard_terms, one[1, 0, 1].raw_jaccard_subdomains, one[1, 0, 1].hierarchical_agreement, one[1, 0, 1].soft_jaccard_terms) == (0.5, 0.0, 1.0, 0.5)
    assert one[1, 0, 2].raw_jaccard_terms is None and one[2, 0, 1].raw_jaccard_terms == 1.0 and one[2, 0, 1].soft_jaccard_terms == 0.0
    metrics = {(r.run_a, r.run_b): r for r in stability.pair_metrics(agreed).collect()}
    assert metrics[0, 1].items == 2 and metrics[0, 1].raw_jaccard_terms == 0.75 and metrics[0, 2].items == 0 and metrics[0, 2].raw_jaccard_terms is None
    mean = stability.mean_metrics(stability.pair_metrics(agreed)).first()
    assert mean.pairs == 3 and mean.raw_jaccard_terms == 0.75


def test_consensus_of_runs(spark):
    rows = [(1, r, ["s"], [f"t{k:02d}" for k in range(r, r + 11)], 0.2 * r, True) for r in range(3)]
    rows += [(2, 0, ["z", "a"], ["q", "b"], 0.9, True), (2, 1, ["c"], ["c"], 0.1, False), (3, 0, ["a"], ["a"], 0.9, False)]
    got = {r.item: r for r in stability.run_consensus(spark.createDataFrame(rows, RUNS)).collect()}
    assert got[1].terms == [f"t{k:02d}" for k in range(12)] and got[1].runs == 3 and got[1].confidence == pytest.approx(0.2)
    assert (got[2].subdomains, got[2].terms, got[2].confidence) == (["z", "a"], ["q", "b"], 0.9)
    assert (got[3].terms, got[3].confidence, got[3].is_valid) == ([], 0.0, False)


def test_floors_and_quality(spark):
    rows = spark.createDataFrame([(["a", "b"], 1, True, True, False), (["a"], 1, False, False, False), (None, 0, True, True, True)], "terms array<string>, anchored_count int, is_valid boolean, source boolean, found boolean")
    q = stability.quality(rows, F.col("source"), F.col("found"))
    got = q.select("*", stability.failed_floors(q, stability.QUALITY, stability.BOUNDS).alias("failed")).first()
    assert (got.coverage, got.anchored_percent, got.modality_fidelity) == (0.666667, 0.666667, -0.333333)
    assert got.failed == ["coverage", "modality_fidelity"]
    m = spark.createDataFrame([(None, 0.7, 0.8)], "soft_jaccard_terms double, nsi double, hierarchical_agreement double")
    assert m.select(stability.failed_floors(m, stability.STABLE).alias("f")).first().f == ["soft_jaccard_terms"]
    assert stability.quality(rows.limit(0)).first().coverage == 0.0
