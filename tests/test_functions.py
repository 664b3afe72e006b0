"""Hand-worked values and small models of the functions."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.functions import arrays as A
from evalloom.functions import jsonx as J
from evalloom.functions import mathx as M
from evalloom.functions import text as T
from evalloom.operators import card, planning, responses, rules, similarity, taxonomy, vocab, windows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("shares", "total", "want"),
    [
        ([0.15, 0.25, 0.30, 0.20, 0.10], 10, [2, 2, 3, 2, 1]),
        ([0.15, 0.25, 0.30, 0.20, 0.10], 13, [2, 3, 4, 3, 1]),
        ([0.15, 0.25, 0.30, 0.20, 0.10], 40, [6, 10, 12, 8, 4]),
        ([0.10, 0.20, 0.35, 0.25, 0.10], 13, [1, 3, 5, 3, 1]),
        ([0.10, 0.20, 0.35, 0.25, 0.10], 300, [30, 60, 105, 75, 30]),
    ],
)
def test_largest_remainder(spark, shares, total, want):
    named = {f"L{i + 1}": s for i, s in enumerate(shares)}
    assert list(M.largest_remainder(named, total).values()) == want
    df = spark.createDataFrame([("g", k, v) for k, v in named.items()], "g string, k string, s double")
    got = windows.allocate(df, ["g"], "s", F.lit(total), "k").orderBy("k").collect()
    assert [r.units for r in got] == want


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=6), st.integers(0, 500))
def test_allocation_sums_to_total(weights, total):
    shares = {str(i): w / sum(weights) for i, w in enumerate(weights)}
    assert sum(M.largest_remainder(shares, total).values()) in (total, total + 1) if total else True


@pytest.mark.parametrize(("values", "want"), [([1, 1, 1, 1], 0.0), ([1, 2, 3, 4], 0.25), ([10, 0, 0, 0], 0.75)])
def test_gini(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "n int")
    assert windows.gini(df, "n").first().gini == want


def test_similarity_values(spark):
    df = spark.createDataFrame([("cache line", "cache lines", 0.9), ("operating system", "operating systems", 0.9375)], "a string, b string, w double")
    for r in df.select(T.bigram_similarity(F.col("a"), F.col("b")).alias("s"), "w").collect():
        assert r.s == pytest.approx(r.w)
    empty = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    r = empty.select(A.jaccard_full(F.col("a"), F.col("b")).alias("full"), A.jaccard_empty(F.col("a"), F.col("b")).alias("zero")).first()
    assert (r.full, r.zero) == (1.0, 0.0)


def test_pearson(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 1.0), ("s", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.p for r in df.groupBy("g").agg(M.pearson("x", "y").alias("p")).collect()}
    assert got["a"] == pytest.approx(0.5) and got["c"] is None and got["s"] is None


def test_numbers(spark):
    assert one(spark, "abc -1.5e3 x", M.extract_numeric) == -1500.0
    assert one(spark, "none", M.extract_numeric) is None
    df = spark.createDataFrame([(1000.05, True), (1000.2, False)], "p double, w boolean")
    assert all(r.c == r.w for r in df.select(M.close(F.col("p"), F.lit(1000.0)).alias("c"), "w").collect())
    assert M.share_split(60, 20, 20) == (15, 5)


def test_idf(spark):
    df = spark.createDataFrame([(d, "x") for d in range(3)] + [(d, f"y{d}") for d in range(3, 10)], "doc_id int, term string")
    w = similarity.tfidf(df).where("term = 'x'").first()
    assert w.df == 3 and w.weight == pytest.approx(1.0)
    assert np.log(11 / 4) + 1 == pytest.approx(2.01160091)


def test_trim_keeps_the_hard_ones(spark):
    df = spark.createDataFrame([(i, "s", d, 60) for i, d in enumerate(["L1", "L1", "L3", "L4", "L5"])], "id int, g string, d string, t int")
    kept = windows.trim_over_quota(df, spark.createDataFrame([("s", 3)], "g string, q int"), ["g"], "q", "d", "t", "id")
    assert sorted(r.d for r in kept.collect()) == ["L3", "L4", "L5"]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("q1", i) for i in range(3)], "id string, p int")
    assert sorted(r.unique_id for r in windows.dup_suffix(df, "id", "p").collect()) == ["q1", "q1_dup1", "q1_dup2"]


def test_text(spark):
    assert one(spark, "（３）. 題目 ", T.strip_numbering) == "題目"
    assert one(spark, "3、 text", T.strip_numbering) == "text"
    assert one(spark, "  It’s\tA  Test. ", T.normalize_text) == "it's a test"
    assert one(spark, "Q?\nAnswer Choices:\nA", T.clean_question) == "Q?"
    assert one(spark, "Meta-Llama/3.1 8B", T.slugify) == "meta_llama_3_1_8b"
    assert one(spark, "a b c", lambda c: T.ngrams(c, 2)) == ["a b", "b c"]
    assert one(spark, "操作系统x", lambda c: T.han_windows(c, 2, 3)) == ["操作", "作系", "系统", "操作系", "作系统"]
    assert one(spark, "cache_lines!", T.normalize_term) == "cache line"
    assert one(spark, "主存储 主存", lambda c: T.longest_first(c, {"主存": "主存储器", "主存储": "主存储器"})) == "主存储器 主存储器"
    got = one(spark, "A. x; B: y;", T.options_of_string)
    assert [(r.letter, r.content) for r in got] == [("A", "x"), ("B", "y")]
    assert one(spark, "```json\n[1]\n```", T.strip_fences) == "[1]"
    assert one(spark, "信念：错误; 情绪：悲伤", lambda c: T.ability_parts(c, ["信念", "情绪"]))[1].label == "悲伤"


def test_json_repair():
    assert json.loads(J.repair('{"a": "x\ny", "b": [1, 2,')) == {"a": "x\ny", "b": [1, 2]}
    assert json.loads(J.repair('{"a": "c:\\path"}'))["a"] == "c:\\path"
    assert [json.loads(x)["i"] for x in J.objects('```json\n[{"i": 1}, {"i": 2}, {"i": ')] == [1, 2]
    assert J.objects('["{\\"i\\": 3}"]') == ['{"i": 3}']
    assert J.objects("no json") == [] and J.objects(None) == []


def test_extraction_gate(spark):
    ok = '```json\n{"subdomains": ["B", "a", "B"], "terms": ["t"], "confidence": 0.5}\n```'
    assert list(one(spark, ok, J.extraction).subdomains) == ["a", "B"]
    assert one(spark, '{"subdomains": ["a"], "terms": ["t"], "confidence": 1.2}', J.extraction) is None
    assert one(spark, "junk", J.extraction) is None
    assert one(spark, '{"label": "Correct", "score": 0.9}', J.judge_verdict).score == 0.9


def test_scoring(spark):
    rows = [
        ("mcq_single", "B", None, " b ", None, True, "mcq_exact_match"),
        ("mcq_multi", None, ["A", "C"], None, ["c", "a", "a"], True, "mcq_multi_set_match"),
        ("mcq_multi", None, ["A"], None, [], False, "empty_pred"),
        ("open_ended", "1000", None, "about 1000.05", None, True, "numeric_exact"),
        ("open_ended", "0", None, "0", None, True, "numeric_exact"),
        ("open_ended", "Hash Table", None, "hash  table.", None, True, "symbolic_exact"),
        ("open_ended", "a longer answer that a judge must read", None, "x", None, None, "judge_required"),
        ("open_ended", "x", None, "", None, False, "empty_pred"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, g string, gs array<string>, p string, ps array<string>, ok boolean, why string")
    for r in df.select("i", "ok", "why", M.score(F.col("t"), F.col("g"), F.col("gs"), F.col("p"), F.col("ps")).alias("s")).collect():
        assert (r.s.is_correct, r.s.reason) == (r.ok, r.why), r


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 4), (4, 3), (5, 5)]:
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in similarity.assign(c))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        want = min(sum(c[i, j] if n <= m else c[j, i] for i, j in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert got == pytest.approx(want)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=5), st.lists(st.text("abc", min_size=1, max_size=4), max_size=5))
def test_soft_jaccard_bounds(a, b):
    x = similarity.soft_jaccard_value(similarity.bigram_matrix(a, b))
    assert 0 <= x <= 1 and x == pytest.approx(similarity.soft_jaccard_value(similarity.bigram_matrix(b, a)))


def test_soft_jaccard_uses_whole_lists(spark, tmp_path):
    """Every distinct word of both halves, against the assignment over the whole matrix."""
    from evalloom import catalog

    rng = random.Random(3)
    texts = {1: [f"abcdefgh{chr(97 + i)}x" for i in range(20)] + [f"abcdefgh{chr(97 + i)}" for i in range(20)], 2: ["x"], 3: []}
    texts |= {4 + k: ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)] for k in range(4)}
    spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.soft_jaccard for r in catalog.queries()["soft_jaccard"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        d = list(dict.fromkeys(t))
        a, b = sorted(d[: -(-len(d) // 2)]), sorted(d[-(-len(d) // 2) :])
        grams = lambda s: {s[k : k + 2] for k in range(len(s) - 1)}
        sim = np.array([[1.0 if s == u else len(grams(s) & grams(u)) / max(1, len(grams(s) | grams(u))) for u in b] for s in a]).reshape(len(a), len(b))
        kept = np.where(sim >= 0.8, sim, 0.0)
        hits = sum(kept[x, y] > 0 for x, y in similarity.assign(-kept)) if a and b else 0
        assert got[i] == pytest.approx(hits / (len(a) + len(b) - hits) if a and b else 0.0, abs=1e-6)


def test_soft_jaccard_compares_words_that_share_bigrams(monkeypatch):
    """The matrix is not built; hits are those of the whole matrix."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 13])))
    cases = [([word() for _ in range(rng.randint(0, 40))], [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    cases += [(["abcdefghij", "x", ""], ["abcdefghik", "x", "", "y"]), (["abcde", "abcdef"], ["abcdeg", "abcde"])]
    want = [similarity.soft_jaccard_value(similarity.bigram_matrix(a, b)) for a, b in cases]
    monkeypatch.setattr(similarity, "bigram_matrix", None)
    assert [similarity._soft(a, b) for a, b in cases] == want


def test_open_ended_normalises_a_text_once(spark):
    """Within the share of words the prediction stands as a bound value, not as its chain of replacements."""
    rows = [("a big memory unit", "Big memory unit here."), ("x", "big memory unit"), ("os", "Operating  System!"), ("7.00001", "7"), ("8", "7"), ("n", "1e5 + 2"), ("The cat", "the cat."), ("ab cd", "ab cd ef"), ("", "")]
    df = spark.createDataFrame(rows, "p string, g string").select(M.score_open_ended(F.col("p"), F.col("g")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, True, True, False, False, True, False, True]
    assert df._jdf.queryExecution().analyzed().toString().lower().count("regexp_replace") <= 9  # 3 a text, once or as in the number's shape


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_text_tfidf(spark, known):
    """The weights of ``tfidf``, whatever tasks know; no row a word is grouped by document and word."""
    texts = [(1, "A b b c"), (2, "a C,d e"), (3, None), (4, ""), (5, "zz top b"), (None, "a b"), (None, "b x")]
    for rows in (texts, [*texts, (1, "c q"), (5, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = similarity.tfidf(vocab.terms(docs, "doc_id", "text"), n_docs=5).select("doc_id", "term", "tf", "df", F.round("weight", 9))
        df = similarity.text_tfidf(docs, "doc_id", "text", 5, known)
        got = df.select("doc_id", "term", "tf", "df", F.round("weight", 9))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) != []
    plan = similarity.text_tfidf(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 5, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 2  # the other words, and the lists at the end


def test_text_parents(spark):
    """The parents of ``parents``, found in a text that is lower-cased once, by the keywords that hold no other."""
    assert taxonomy.needed(["Graph theory", "graph", "cache", "cache", "tree"]) == ["graph", "cache", "tree"]
    tables = [taxonomy.CS_PARENTS, taxonomy.MATH_PARENTS, {"Z": ["q"], "A": ["Q", "x y"]}]
    keys = sorted({k for t in tables for keys in t.values() for k in keys})
    texts = [None, "", "nothing", *keys, *(k.upper() + " and" for k in keys), "X Y", "x  y", " ".join(keys)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", taxonomy.text_parents(F.col("t"), *tables).alias("p"), *(taxonomy.parents(F.array("t"), t).alias(f"w{i}") for i, t in enumerate(tables)))
    assert all((r.p.t0, r.p.t1, r.p.t2) == (r.w0, r.w1, r.w2) for r in found.collect())
    plan = df.select(taxonomy.text_parents(F.col("t"), *tables).alias("p")).select("p.t0", "p.t1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "contains" not in plan


def test_greedy_leaders(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    got = {r.id: r.leader for r in similarity.greedy_leaders(edges, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}  # 3 is near 2 only, and 2 does not lead


def test_greedy_drop_of_copies(spark, tmp_path):
    """The query against the sequential pass over all documents; copies of leaders and of dropped rows go too."""
    from evalloom import catalog

    w = [f"w{i}" for i in range(20)]
    texts = {1: w, 2: w[::-1], 3: w[:18], 4: ["other"], 5: w[2:18], 6: w[:18] * 2, 7: [], 8: None, 9: ["other"] * 3, 10: w[2:18], 11: []}
    spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, leaders = {}, []
    for i, t in texts.items():
        x = set(t or [])
        want[i] = next((h for h in leaders if x and len(x & set(texts[h] or [])) >= 0.8 * len(x | set(texts[h] or []))), i)
        leaders += [i] if want[i] == i else []
    got = {r.id: r.leader for r in catalog.queries()["greedy_near_dup_drop"](spark, str(tmp_path)).collect()}
    assert got == want and got[2] == 1 and got[6] == 1 and got[9] == 4


def test_pairs_and_members_reach_all_copies(spark, tmp_path):
    """Pairs and membership together give every pair of near texts; a class without a near neighbour is there too."""
    from evalloom import catalog

    w = [f"w{i}" for i in range(10)]
    texts = {1: w, 2: w[:9], 3: w[::-1], 4: w[:9] * 2, 5: ["lone"], 6: ["lone", "lone"], 7: [], 8: []}
    spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    first = {r.id: r.representative for r in run("near_dup_members")}
    near = {(r.a, r.b) for r in run("near_dup_pairs")}
    got = {(a, b) for a in first for b in first if a < b and texts[a] and (first[a] == first[b] or tuple(sorted((first[a], first[b]))) in near)}
    assert got == {(a, b) for a in texts for b in texts if a < b and texts[a] and len(set(texts[a]) & set(texts[b])) >= 0.8 * len(set(texts[a]) | set(texts[b]))}
    assert first == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 5, 7: 7, 8: 8}


def test_tfidf_pairs_drop_and_rate(spark, tmp_path):
    """Cosine join, greedy pass and rate against the sequential pass over the whole matrix."""
    from evalloom import catalog

    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(40)] for _ in range(5)]
    texts = [b[: len(b) - cut] for b in base for cut in (0, 0, 1, 2, 4, 9)] + [[], []]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    words = sorted({w for t in texts for w in t})
    tf = np.array([[t.count(w) for w in words] for t in texts], float)
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.round(x @ x.T, 6) >= 0.955
    leader = {}
    for i in range(len(texts)):
        leader[i] = next((h for h in range(i) if leader[h] == h and near[h, i]), i)
    first = [min(j for j in range(len(texts)) if i == j or texts[i] and (tf[i] == tf[j]).all()) for i in range(len(texts))]
    assert {r.id: r.representative for r in run("tfidf_members")} == dict(enumerate(first))
    assert {(r.a, r.b) for r in run("tfidf_pairs")} == {(a, b) for a in set(first) for b in set(first) if a < b and near[a, b]}
    assert {r.id: r.leader for r in run("tfidf_near_dup_drop")} == leader
    dropped = sum(k != v for k, v in leader.items())
    assert [tuple(r) for r in run("deduplication_rate")] == [(len(texts), dropped, round(dropped / len(texts), 6))] and dropped > 5


def test_anchored_terms_reach_the_whole_enum(spark, tmp_path):
    """Terms of rank 41 and more count."""
    from evalloom import catalog

    names = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(1, " ".join(names)), (2, " ".join(names)), (3, names[59]), (4, "nothing"), (5, "void"), (6, "empty")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.anchored for r in catalog.queries()["anchored_terms_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 60, 2: 60, 3: 1, 4: 0, 5: 0, 6: 0}


def test_neighbours_in_blocks(spark):
    """More queries than a block holds give the same rows as one block."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    got = [sorted(tuple(r) for r in similarity.top_neighbours(df, df, 3, most=m).collect()) for m in (7, 100)]
    assert got[0] == got[1] and len(got[0]) == 120


def test_question_rules(spark):
    from evalloom.schemas import QUESTION

    base = {c.split()[0]: None for c in []} | dict(id="q", question_stem="what", answer_explanation="long enough text", design_type="standard", difficulty="L2", question_type="mcq_single", options=["a", "b"], answer_text="A", answer_set=None, estimated_time_sec=60, subdomain="s")
    bad = base | dict(id="b", options=["a"], answer_set=["A"], answer_text=None, estimated_time_sec=601, difficulty="L9", subdomain="")
    df = spark.createDataFrame([base, bad], QUESTION)
    got = {r.id: r.f for r in df.select("id", rules.flags(rules.question_rules()).alias("f")).collect()}
    assert got["q"] == []
    assert got["b"] == ["bad_difficulty", "few_options", "missing_subdomain", "single_answer_is_list", "time_out_of_range"]


def test_plan_covers_every_quota():
    batches = planning.plan(planning.CS_COVERAGE)
    for q in planning.CS_COVERAGE.quotas:
        mine = [b for b in batches if b.parent == q.parent]
        assert (sum(b.standard for b in mine), sum(b.adversarial for b in mine)) == (q.standard, q.adversarial)
    assert planning.CS_COVERAGE.total == 300
    lack = {"L1": 3, "L2": 5}
    assert planning.take_from(lack, 4) == {"L1": 3, "L2": 1} and lack == {"L1": 0, "L2": 4}


def test_card_and_report():
    text = card.to_yaml({"meta": {"n": 1}, "ontology": [{"super_parent": "A", "count": 2}]})
    assert "super_parent" in text and "count: 2" in text
    assert "FAIL" in card.report("r", {"coverage": 0.5}, {"coverage": 0.95}) and "PASS" in card.report("r", {"coverage": 0.96}, {"coverage": 0.95})
    assert [card.quality_label(*x) for x in ((0, 0), (1, 1), (2, 3), (9, 9))] == ["excellent", "good", "fair", "poor"]


def test_clean_terms(spark):
    df = spark.createDataFrame([("a_en", [" Law of", "law of motion", "Law of", "state of the", "state of the art", "end of", "Motions", "misc", ""]), ("b_zh", ["内存", "内存管理", "我的", "内存管理", " 栈 ", "禁"]), ("c_en", None)], "d string, t array<string>")
    got = {r.d: (r.en, r.zh, r.any) for r in df.select("d", T.clean_terms_en(F.col("t"), {"motions": "motion"}, ["misc"]).alias("en"), T.clean_terms_zh(F.col("t"), ["禁"]).alias("zh"), T.clean_terms(F.col("d"), F.col("t")).alias("any")).collect()}
    assert got["a_en"][0] == ["law of motion", "state of the art", "end of", "motion"]
    assert got["b_zh"][1] == ["内存管理", "栈"] and got["b_zh"][2] == ["内存管理", "栈", "禁"] and got["c_en"] == (None, None, None)


def test_form_reason(spark):
    df = spark.createDataFrame([("", 5), ("ab", 5), ("the of", 5), ("cache", 2), ("cache", 60), ("cache!", 5), ("the topic", 5), ("cache (l1)", 5), ("栈", 5), ("内存管理", 1), ("内存管理", 2), ("内存x", 3), ("栈" * 13, 5)], "t string, df long")
    got = [r[0] for r in df.select(rules.form_reason(F.col("t"), F.col("df"), F.lit(100), ["the", "of"])).collect()]
    assert got == ["empty", "too_short", "all_stopwords", "too_rare", "too_common", "invalid_charset", "placeholder_suffix", None, "too_short", "too_rare", None, "invalid_charset", "too_long"]


def test_sample_by_and_running_id(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None) for i in range(100)], "id long, g string").repartition(7)
    got = windows.sample_by(df, ["g"], 4, 1, "id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 4, "b": 4, "c": 4, None: 4}
    numbered = windows.running_id(df, "g", "id").collect()
    for g in ("a", "b", "c", None):
        mine = sorted((r.id, r.running_id) for r in numbered if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_hygiene_ignores_case(spark):
    df = spark.createDataFrame([(["Cache", "cache", "gone", "Stack"], "a cache and a stack, a queue", ["CACHE", "Queue"])], "t array<string>, s string, g array<string>")
    assert df.select(responses.hygiene(F.col("t"), F.col("s"), F.col("g"), fold_case=True)).first()[0] == ["Cache", "Queue", "Stack"]


def test_topups(spark):
    difficulty, formats = {"L1": 5, "L2": 40}, {"mcq": 45}
    made = planning.topup_plan([("a", "adversarial", 25), ("b", "standard", 10)], difficulty, formats)
    assert [(b.parent, b.index, b.standard, b.adversarial) for b in made] == [("a", 1, 0, 20), ("a", 2, 0, 5), ("b", 1, 10, 0)]
    assert made[0].difficulty == {"L1": 5, "L2": 15} and sum(b.formats["mcq"] for b in made) == 35 and difficulty == {"L1": 0, "L2": 10}
    assert planning.avoid([]) == "" and planning.avoid(["x" * 200]).count("x") == 120
    assert planning.coverage_table(planning.CS_COVERAGE).splitlines()[-1].split() == ["total", "225", "75"]
    first = spark.createDataFrame([(1,)], "n int")
    got = planning.generate(first, lambda d: d.groupBy().agg(F.max("n").alias("n")).where("n < 3"), lambda need: need.select((F.col("n") + 1).cast("int").alias("n")), rounds=5)
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]
