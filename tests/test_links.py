"""Pairs, components and greedy leaders against plain passes."""

import math
import pathlib
import random
import re

import pytest

from evalloom.operators import components, similarity


def graph(kind, rng):
    if kind == "chain":
        return [(k, k + 1) for k in range(90)] + [(200, 100), (200, 300)]
    if kind == "clique":
        return [(a, b) for a in range(12) for b in range(12) if a != b] + [(50, 51), (51, 51)]
    if kind == "none":
        return []
    return [(rng.randrange(120), rng.randrange(120)) for _ in range(110)]


@pytest.mark.parametrize("kind", ["chain", "clique", "random", "none"])
def test_components_and_leaders(spark, kind):
    rng = random.Random(4)
    edges = graph(kind, rng)
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.root for r in components.connected(df).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    near = {}
    for a, b in edges:
        near.setdefault(max(a, b), set()).add(min(a, b))
    leader = {}
    for n in range(310):
        heads = [u for u in sorted(near.get(n, ())) if u < n and leader[u] == u]
        leader[n] = heads[0] if heads else n
    nodes = spark.range(310)
    for rounds in (0, 2, 12):
        assert {r.id: r.leader for r in similarity.greedy_leaders(df.selectExpr("least(a, b) a", "greatest(a, b) b"), nodes, rounds=rounds).collect()} == leader


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_jaccard_pairs(spark, threshold, monkeypatch):
    """A token of all sets, sizes from one to many, equal sets, groups; few tokens count as frequent."""
    monkeypatch.setattr(similarity, "FREQUENT", 5)
    rng = random.Random(9)
    base = [" ".join(["the", *rng.sample([f"w{k}" for k in range(40)], rng.randint(0, 25))]) for _ in range(25)]
    texts = []
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts.append((k, " ".join(words), None if k % 9 == 0 else k % 2))
    texts += [(900, None, 0), (901, "!!", 0)]
    df = spark.createDataFrame(texts, "id long, text string, g int")
    for group in (None, "g"):
        first = {}
        for i, t, g in texts:
            s = frozenset(re.findall("[a-z0-9]+", (t or "").lower()))
            if s:
                first.setdefault((g if group else 0, s), i)
        sets = [(i, g, s) for (g, s), i in first.items()]
        want = {(a, b) for a, g, s in sets for b, h, t in sets if a < b and g == h and g is not None and 10 * len(s & t) >= round(10 * threshold) * len(s | t)}
        got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, "id", "text", threshold, group).collect()}
        assert got == want
    members = {r.id: r.representative for r in similarity.token_classes(df, "id", "text").collect()}
    by = {}
    for i, t, _ in texts:
        s = frozenset(re.findall("[a-z0-9]+", (t or "").lower()))
        assert members[i] == (by.setdefault(s, i) if s else i)


@pytest.mark.parametrize("cell", [4, 4096])
def test_cosine_pairs_of_a_large_group(spark, monkeypatch, cell):
    """A group of near copies in one cell and cut into many, terms known to tasks and joined, identifiers of several rows; pairs are not joined with terms."""
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity, "WEIGHED", 3)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(words[:50] + rng.sample(words, 2))) for k in range(40)] + [(k, " ".join(rng.sample(words, 9))) for k in range(40, 60)] + [(5, "w1 w2"), (70, None), (71, "")]
    whole = {}
    for i, t in texts:
        whole.setdefault(i, []).extend((t or "").split())
    df = {w: sum(w in t for t in whole.values()) for w in words}
    vec = {i: {w: t.count(w) * (math.log((1 + len(whole)) / (1 + df[w])) + 1) for w in set(t)} for i, t in whole.items()}
    dot = lambda a, b: sum(x * vec[b].get(w, 0) for w, x in vec[a].items())
    kept = {min(j for j in vec if whole[i] and vec[i] == vec[j]) for i in vec if whole[i]}
    want = {(a, b): dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for a in kept for b in kept if a < b and round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 6) >= 0.955}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    counts = similarity.term_counts(docs, "doc_id", "text")
    classes = similarity.term_classes(docs, counts)
    got = similarity.cosine_pairs(counts, len(whole), classes.where("id <> representative").select("id").distinct(), 0.955)
    rows = got.collect()
    assert {(r.a, r.b): r.cosine for r in rows} == pytest.approx(want, abs=1e-6) and len(rows) == len(want) > 300
    assert "Generate" not in classes._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("heavy", "kind"), [(3, "string"), (16_384, "long")])
def test_jaccard_of_large_unlike_sets(spark, monkeypatch, heavy, kind):
    """Sets of many tokens that share a few are no candidates, and no list of tokens is kept; a token's rows in one cell or in many, in blocks of any size."""
    for name, value in (("HEAVY", heavy), ("BLOCK", 50), ("MEET", 30)):
        monkeypatch.setattr(similarity, name, value)
    kept = {}
    keep = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    rng = random.Random(3)
    words = [f"w{k}" for k in range(1200)]
    sets = [set(rng.sample(words, 400)) for _ in range(60)]
    sets += [s - set(rng.sample(sorted(s), 20)) for s in sets[:30]]
    name = (lambda k: f"d{k:03}") if kind == "string" else int
    df = spark.createDataFrame([(name(k), " ".join(sorted(s))) for k, s in enumerate(sets)], f"id {kind}, text string").repartition(3)
    want = {(name(a), name(b)): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in range(90) for b in range(a + 1, 90)}
    got = {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df, "id", "text", 0.8).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.8} and len(got) == 30
    assert kept["groups"].count() <= 40
    assert not any(f.exists() for f in map(pathlib.Path, {x.removeprefix("file:") for x in kept["token-sets"].inputFiles()}))


def test_greedy_drop_keeps_one_table_of_tokens(spark, small, monkeypatch):
    """Names of the sets are stored without their tokens, and candidates travel as lists."""
    from evalloom import catalog

    names = []
    keep = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: names.append((name, df.columns)) or keep(df, name))
    assert catalog.queries()["greedy_near_dup_drop"](spark, small).count() == 200
    assert [n for n, c in names if "tokens" in c] == ["token-sets"] and ("set-names", ["id", "name"]) in names


@pytest.mark.parametrize("heavy", [3, 16_384])
def test_cosine_of_unlike_vectors(spark, monkeypatch, heavy):
    """Vectors that share a part of their terms are no candidates, a pair is listed a few times at most, and counts that nothing else reads are deleted."""
    for name, value in (("HEAVY", heavy), ("BLOCK", 50), ("MEET", 30)):
        monkeypatch.setattr(similarity, name, value)
    kept = {}
    keep = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = [t.split() for t in texts]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in t for t in whole))) + 1 for w in words}
    vec = [{w: t.count(w) * idf[w] for w in set(t)} for t in whole]
    dot = lambda a, b: sum(x * vec[b].get(w, 0) for w, x in vec[a].items())
    want = {(a, b): c for a in range(90) for b in range(a + 1, 90) if (c := round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 6)) >= 0.955}
    counts = keep(similarity.term_counts(docs, "doc_id", "text"), "term-counts")
    got = similarity.cosine_pairs(counts, len(texts), spark.createDataFrame([], "id long"), 0.955, once=True)
    assert {(r.a, r.b): r.cosine for r in got.collect()} == pytest.approx(want, abs=2e-6) and len(want) == 30
    assert kept["groups"].count() <= 100
    assert not any(pathlib.Path(x.removeprefix("file:")).exists() for frame in (counts, kept["frequent"]) for x in frame.inputFiles())
