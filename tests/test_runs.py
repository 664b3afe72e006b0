"""Nested context, numbered lines, manifests, audits, selection by spelling, top-up rounds, names of clusters."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.functions import jsonx
from evalloom.operators import manifest, selection, similarity, topup
from evalloom.operators.topup import draw
from evalloom.sources import readers, sinks


def walk(x):
    if isinstance(x, str):
        return [x]
    return [s for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for s in walk(v)]


def test_strings_of_nested_json(spark):
    rng = random.Random(2)
    words = ["", " a ", 'q"q', "back\\", '\\"', "a:b", "x, [y]", "é\n\t", "{", '":"', " ", "null", "\\u0041"]

    def build(depth):
        kind = rng.randrange(6) if depth else rng.randrange(3)
        if kind < 3:
            return rng.choice([rng.choice(words), rng.choice(words), 1.5, None, True])
        return [build(depth - 1) for _ in range(rng.randint(0, 4))] if kind < 4 else {rng.choice(words) + str(k): build(depth - 1) for k in range(rng.randint(0, 4))}

    texts = [json.dumps(build(5), ensure_ascii=k % 2 == 0, indent=None if k % 3 else 1) for k in range(300)] + ['"alone"', "[" + '"\\\\", ' * 20_000 + '"end"]']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: r.s for r in df.select("k", jsonx.strings(F.col("t")).alias("s")).collect()}
    assert all(got[k] == walk(json.loads(t)) for k, t in enumerate(texts))
    odd = spark.createDataFrame([(None,), ("not json",), ('{"a": [" x ", {"b": "y"}]}',)], "t string")
    assert [r.c for r in odd.select(jsonx.context_lines(F.col("t")).alias("c")).collect()] == [[], [], ["Context: x", "Context: y"]]


def test_lines_of_split_files(spark, tmp_path):
    """A file read in many splits numbers like one."""
    rng = random.Random(3)
    rows = {}
    for name in ("a", "b"):
        lines = [rng.choice(["", "  ", "{bad", json.dumps({"x": rng.randrange(100), "pad": "p" * rng.randrange(200)})]) for _ in range(700)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        rows[name] = lines
    schema = StructType.fromDDL("x long, pad string")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("3000", before):
            spark.conf.set(key, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            got = {}
            for r in readers.lines(spark, str(tmp_path)).collect():
                got.setdefault(r.file[-7], {})[r.line] = r.value
            assert {n: [got[n][k] for k in range(1, 701)] for n in got} == rows
            good, bad = readers.numbered(spark, str(tmp_path), schema)
            assert sorted((r.file[-7], r.line) for r in bad.collect()) == [(n, k) for n in "ab" for k, v in enumerate(rows[n], 1) if v == "{bad"]
            assert {(r.file[-7], r.line, r.x) for r in good.collect()} == {(n, k, json.loads(v)["x"]) for n in "ab" for k, v in enumerate(rows[n], 1) if v.startswith('{"')}
            counts = {r.file[-7]: (r.lines, r.blank, r.bad, r.good) for r in readers.line_counts(spark, str(tmp_path), schema).collect()}
            assert counts == {n: (700, sum(not v.strip() for v in rows[n]), rows[n].count("{bad"), sum(v.startswith('{"') for v in rows[n])) for n in "ab"}
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_digest_of_a_table(spark):
    rows = [(1, "a", None), (2, "b", "c"), (2, "b", "c"), (3, "", "N")]
    df = spark.createDataFrame(rows, "x long, y string, z string")
    one = lambda d: tuple(manifest.multiset_digest(d).first())
    assert len({one(df.repartition(n)) for n in (1, 7)}) == 1 and one(df) == one(df.orderBy(F.desc("x")).select("z", "y", "x"))
    others = [rows[:3], [*rows[:3], (3, "", None)], [*rows[:3], (3, "N", "")], [(1, "a", None), (1, "a", None), *rows[1:3]], [*rows[:3], (3, " ", "N")]]
    assert len({one(df), *(one(spark.createDataFrame(o, df.schema)) for o in others)}) == 6
    assert one(df.limit(0))[0] == 0
    got = manifest.run_manifest(df, "d", "prompt", {"a": "b"}, runs=2).first()
    assert (got.dataset, got["rows"], got.settings) == ("d", 4, '{"runs": 2}') and len(got.dataset_hash) == len(got.prompt_hash) == 16
    by = {r.x: r["rows"] for r in manifest.multiset_digest(df, ["y", "z"], ["x"]).collect()}
    assert by == {1: 1, 2: 2, 3: 1}


def test_a_run_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    where = sinks.run(df, manifest.run_manifest(df, "d"), {"passed": True}, str(tmp_path), "s")
    report = json.loads(open(f"{where}/report.json").read())
    assert report["passed"] and report["manifest"]["rows"] == 2 and readers.jsonl(spark, f"{where}/results").count() == 2


def test_audit_of_removals(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(9)], "id long, m long")
    kept = df.where("m = 1 or id = 6")
    got = {r.reason: (r.removed, r.first_key, r.last_key) for r in manifest.removal_audit(df, kept, "id", F.when(F.col("m") == 0, "zero")).collect()}
    assert got == {"zero": (2, 0, 3), "other": (3, 2, 8), None: (5, 0, 8)}


def test_selection_by_spelling(spark):
    entries = spark.createDataFrame([("gpt-4o", "GPT 4o (new)"), ("claude_x", "Claude X"), ("qwen", "Claude-X"), ("none", None)], "key string, name string")
    asked = spark.createDataFrame([(x,) for x in ["gpt-4o", "GPT-4O", "gpt4o", "Gpt 4o", "gpt_4o_new", "claude x", "ClaudeX", " qwen ", "who", "", None]], "n string")
    got = {r.asked: (r.key, r.rank, r.candidates) for r in selection.select(asked, entries, "n", "key", ["key", "name"]).collect()}
    assert got["gpt-4o"][:2] == ("gpt-4o", 0) and got["GPT-4O"][:2] == ("gpt-4o", 0) and got["gpt4o"] == ("gpt-4o", 3, 1)
    assert got["Gpt 4o"][0] == got["gpt_4o_new"][0] == "gpt-4o" and got[" qwen "][0] == "qwen"
    assert got["claude x"][0] == "claude_x" and got["ClaudeX"][0] == "claude_x"
    assert got["who"] == (None, None, 0) and got[""] == (None, None, 0) and None not in got
    both = spark.createDataFrame([("b", "Same"), ("a", "same")], "key string, name string")
    found = selection.select(spark.createDataFrame([("same",)], "n string"), both, "n", "key", ["key", "name"]).first()
    assert (found.key, found.candidates) == ("a", 1)
    loose = spark.createDataFrame([("b", "Same"), ("a", "SamE")], both.schema)
    found = selection.select(spark.createDataFrame([("SAME",)], "n string"), loose, "n", "key", ["key", "name"]).first()
    assert (found.key, found.candidates) == ("a", 2)


def test_answerers_of_file_names(spark):
    files = spark.createDataFrame([("x/cs_stage3_answers_m1_vs_GPT_4o.jsonl",), ("x/cs_stage3_answers_m1_vs_other.jsonl",)], "_file string")
    entries = spark.createDataFrame([("gpt-4o", "GPT 4o")], "key string, name string")
    got = {r.asked: r.key for r in selection.select(readers.pair_models(files), entries, "answerer", "key", ["key", "name"]).collect()}
    assert got == {"GPT_4o": "gpt-4o", "other": None}


def plain_targets(lacks, remaining, per_call, fallback):
    out = []
    for parent, std, adv in lacks:
        need = std + adv
        if need <= 0 and remaining <= 0:
            continue
        total = min(need, per_call) if need > 0 else min(fallback, remaining) if remaining > 0 else fallback
        if remaining > 0:
            total = min(total, remaining)
        total = max(1, min(total, per_call))
        s = min(std, total)
        a = min(adv, total - s)
        out.append((parent, total, total - a, a))
        remaining = max(0, remaining - total)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_draws(spark, seed):
    rng = random.Random(seed)
    lacks = [(f"p{k}", rng.choice([0, 0, 3, 30]), rng.choice([0, 2, 9])) for k in range(9)]
    remaining = rng.choice([0, 7, 25, 200])
    df = spark.createDataFrame(lacks, "parent string, standard long, adversarial long").withColumn("r", F.lit(remaining))
    got = sorted(tuple(r) for r in topup.targets(df, F.col("r"), per_call=12, fallback=5, most=12).collect())
    want = plain_targets(lacks, remaining, 12, 5)
    assert got == want
    shares = {"L1": 0.15, "L2": 0.25, "L3": 0.3, "L4": 0.2, "L5": 0.1}
    deficits = {k: rng.choice([0, 4, 15]) for k in shares}
    if not want:
        return
    requests = spark.createDataFrame([(p, t) for p, t, _, _ in want], "parent string, total long")
    rows = draw(requests, spark.createDataFrame([(k, i, deficits[k], shares[k]) for i, k in enumerate(shares)], "key string, pos int, deficit long, share double")).collect()
    left = dict(deficits)
    for parent, total, _, _ in want:
        mine, need = Counter(), total
        for k in shares:
            take = min(left[k], need)
            mine[k], left[k], need = take, left[k] - take, need - take
        exact = {k: round(v * need, 9) for k, v in shares.items()}
        more = {k: int(v) for k, v in exact.items()}
        for k in sorted(shares, key=lambda k: -round(exact[k] - more[k], 9))[: need - sum(more.values())]:
            more[k] += 1
        assert {r.key: r.units for r in rows if r.parent == parent} == {k: mine[k] + more[k] for k in shares}


def test_rounds_end(spark):
    have = spark.createDataFrame([("a", "standard", 0)], "parent string, design string, generation_index long")
    pool = spark.createDataFrame([("a", "standard", k) for k in range(1, 30)] + [("a", "adversarial", 100)], have.schema)
    quotas = spark.createDataFrame([("a", 25, 3)], "parent string, standard long, adversarial long")
    total, asked = topup.rounds(have, pool, quotas, 5, per_call=10)
    rows = Counter((r.round, r.design) for r in total.collect())
    assert rows[1, "standard"] == 10 and sum(n for (_, d), n in rows.items() if d == "standard") == 25 and sum(n for (_, d), n in rows.items() if d == "adversarial") == 1
    assert total.select("generation_index", "design").distinct().count() == total.count() and asked.count() >= 3


def test_clusters_are_named_and_numbered(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((5, 8))
    data = [(k, (centre[k % 5] * 4 + 0.1 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 9)) if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n long")
    runs = [{r.id: r.cluster for r in similarity.kmeans(df.repartition(p), 5).collect()} for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 200
    sizes = Counter(runs[0].values())
    first = {c: min(i for i, x in runs[0].items() if x == c) for c in sizes}
    assert sorted(sizes, key=lambda c: (-sizes[c], first[c])) == list(range(len(sizes)))
    often = {k: n or 0 for k, _, n in data}
    named = similarity.name_parents(similarity.kmeans(df, 5).join(df.selectExpr("vec_id id", "n frequency"), "id")).collect()
    for r in named:
        members = [i for i, c in runs[0].items() if c == runs[0][r.id]]
        assert (r.parent, r.members, r.total) == (min(members, key=lambda i: (-often[i], i)), len(members), sum(often[i] for i in members))
    few = similarity.kmeans(df.limit(3), 50).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2]
