"""Profiles, taggers, sibling labels, payloads and hygiene on small tables of cases."""

import json

from pyspark.sql import functions as F

from evalloom.operators import items


def test_characteristics(spark):
    rows = [("a", "en", "MCQ", "Visual", "x", True), ("a", None, "MCQ", None, "", False), ("a", "en", None, "text", "y", None), ("b", "de", "Open", "Mixed", None, None), ("b", "en", "Open", "MULTIMODAL", None, None)]
    df = spark.createDataFrame(rows, "s string, language string, format string, modality string, label string, image boolean").repartition(3)
    expected = spark.createDataFrame([("a", 3), ("b", 9)], "s string, expected_size long")
    got = {r.split: r for r in items.characteristics(df, "s", expected, "label", F.col("image")).collect()}
    assert (got["a"].total_size, got["a"].size_match, got["a"].primary_language, got["a"].language_purity, got["a"].primary_format) == (3, True, "en", 0.666667, "MCQ")
    assert (got["a"].multimodal_ratio, got["a"].subdomain_count, got["a"].has_images) == (0.333333, 2, True)
    assert (got["b"].size_match, got["b"].primary_language, got["b"].multimodal_ratio, got["b"].has_images) == (False, "de", 1.0, False)
    assert items.characteristics(df, "s").where("not size_match").count() == 0
    assert items.characteristics(df.limit(0), "s").collect() == []


def test_taggers_keep_native_labels(spark):
    rows = [(1, ["n"], None, ["t"]), (2, ["t"], ["n"], ["u"]), (3, ["n"], None, []), (4, None, None, ["t"])]
    df = spark.createDataFrame(rows, "id long, subdomains array<string>, subdomains_native array<string>, tags array<string>")
    got = {r.id: (r.r.subdomains, r.r.subdomains_native, r.r.subdomains_canonical) for r in df.select("id", items.tag(F.struct("subdomains", "subdomains_native"), F.col("tags")).alias("r")).collect()}
    assert got == {1: (["t"], ["n"], ["t"]), 2: (["u"], ["n"], ["u"]), 3: (["n"], ["n"], None), 4: (["t"], None, ["t"])}


def test_labels_of_a_sibling_set(spark):
    own = spark.createDataFrame([(" 1",), ("2",), ("3",), ("",), (None,)], "id string")
    other = spark.createDataFrame([("1 ", ["b", "a", "b", "?"]), ("2", []), ("", ["a"]), (None, ["a"])], "id string, labels array<string>")
    mapping = spark.createDataFrame([("a", "A"), ("b", "B")], "label string, canonical string")
    got = {r.id: r.labels for r in items.sibling_labels(own, other, mapping).collect()}
    assert got == {" 1": ["B", "A"], "2": [], "3": [], "": [], None: []}


def test_payloads(spark):
    values = ['{"a": 1}', '[{"a": 1}, 2, {"b": []}, "x", null]', "null", "[]", '"s"', "3"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, t string").withColumn("v", F.parse_json("t"))
    got = {r.k: (r.l, [json.loads(x) for x in r.o]) for r in df.select("k", F.size(items.as_list(F.col("v"))).alias("l"), F.transform(items.objects(F.col("v")), lambda x: F.to_json(x)).alias("o")).collect()}
    assert got == {0: (1, []), 1: (5, [{"a": 1}, {"b": []}]), 2: (0, []), 3: (0, []), 4: (1, []), 5: (1, [])}


def test_model_ids_and_previews(spark):
    df = spark.createDataFrame([("m", "x"), ("", "GPT 4o!"), (None, None)], "i string, n string")
    assert [r.m for r in df.select(items.model_id(F.col("i"), F.col("n")).alias("m")).collect()] == ["m", "gpt_4o", None]
    row = items.preview(spark.createDataFrame([(list("abcde"), list("xyz"))], "t array<string>, p array<string>"), "t", "p").first()
    assert row.t == list("abc") and row.p == list("xy")


def test_hygiene(spark):
    good = lambda t: len(t) > 1 and t.lower() != "denied"
    short = lambda t: len(t.split()) < 4
    kind = lambda t: "context" if t.startswith("ctx") else "other"
    clean = lambda terms, text, glossary=(), subs=(): items.clean_extraction(list(terms), list(subs), text, list(glossary), good, short, kind)
    assert clean(["Cache", "cache ", "denied", "absent", "one two three four", ""], "cache one two three four denied fast", ["denied", "slow", "fast", "cache"])[0] == ["Cache", "fast"]
    assert clean(["absent"] * 3, "fast slow", ["slow", " fast "])[0] == ["slow", "fast"]
    words = [f"w{k}" for k in range(20)]
    assert clean(words, " ".join(words))[0] == words[:12]
    context = [f"ctx{k}" for k in range(9)]
    assert clean(context, " ".join(context))[0] == context[:5]
    assert clean(["aa", *context[:6]], " ".join(["aa", *context]))[0] == ["aa", *context[:5]]
    assert clean([], "", subs=[" A1", "a1", "denied", "x", "b2", "c3", "d4"])[1] == ["A1", "b2", "c3"]
    schema = "id long, terms array<string>, subdomains array<string>, text string, glossary array<string>, confidence double, is_valid boolean"
    rows = [(1, ["cache", None], ["s1"], "a cache", None, 0.9, True), (2, ["gone"], None, None, ["x"], 0.8, True), (3, ["kept"], ["k"], "no", None, 0.7, False)]
    got = {r.id: r for r in items.hygiene_pass(spark.createDataFrame(rows, schema), good, short, kind).collect()}
    assert (got[1].terms, got[1].anchored_count, got[1].anchored_fraction, got[1].confidence) == (["cache"], 1, 1.0, 0.9)
    assert (got[2].terms, got[2].subdomains, got[2].anchored_count, got[2].confidence) == ([], [], 0, 0.0)
    assert (got[3].terms, got[3].anchored_count, got[3].confidence) == (["kept"], None, 0.7)
