"""Vocabulary of a corpus, concept categories, paths, contexts, repeated requests; small cases and odd input."""

import os.path

import pytest
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import context, lexicon, responses, vocab


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_paths(spark):
    cases = ["", ".", "/", "a//b", "./a/./b/", "a/../../b", "/../a/..", "../../x", "a/b/../c", "/a/./../..", "..", "a/.."]
    df = spark.createDataFrame([(c,) for c in cases], "x string").select("x", context.normal_path(F.col("x")).alias("y"), context.join_path("r/s", F.col("x")).alias("z"))
    assert {r.x: (r.y, r.z) for r in df.collect()} == {c: (os.path.normpath(c), os.path.normpath(os.path.join("r/s", c))) for c in cases}


def test_context_of_nulls(spark):
    df = spark.createDataFrame([("tomb_x", None, None), ("wemath", ["2steps/image/a.png", None, "", "b\\c.png"], ["s"]), (None, ["q"], ["s"]), ("TombEn", ["q"], [" ", "story"])], "s string, p array<string>, t array<string>")
    got = [tuple(r.c) for r in df.select(context.context_pack(F.col("s"), {"story": F.col("t")}, {}, F.col("p"), None, "/d").alias("c")).collect()]
    assert got == [([], [], []), ([], ["/d/data/raw_data/wemath/2steps/image/a.png", "b/c.png"], []), ([], [], []), (["story"], [], [])]
    loose = {"x": {"images": {"enabled": True}}}
    pack = df.limit(1).select(context.context_pack(F.lit("x"), {}, {"image_path": F.array(F.lit("k"))}, F.array(F.lit("a/./b"), F.lit("k")), None, "", loose).alias("c")).first().c
    assert pack.images == ["a/./b", "k"]


@pytest.mark.parametrize(("text", "want"), [("Stacks_and-Queues!", "stacks and queue"), ("class", "class"), ("gas", "gas"), ("  ", ""), ("C++ (a*b)", "c++ (a*b)"), ("計算機 系统，ab（1）", "计算机系统(1)")])
def test_corpus_form(spark, text, want):
    assert one(spark, text, vocab.corpus_form) == want


def test_corpus_enum(spark):
    assert one(spark, "Cats cat a_b", vocab.corpus_terms) == ["cat", "cat", "a b", "cats cat", "cat a b"]
    assert one(spark, None, vocab.corpus_terms) is None
    texts = ["system call", "the system call", "system calls of it", None, ""] + ["x"] * 5
    freq = vocab.corpus_frequencies(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    rows = {r.term: (r.tf, r.df) for r in freq.collect()}
    assert rows["system"] == (3, 3) and rows["system call"] == (3, 3) and rows["x"] == (5, 5) and rows["calls of"] == (1, 1) and "" not in rows
    more = spark.createDataFrame([("System Calls",), ("",), (None,)], "term string")
    enum = vocab.corpus_enum(freq, 10, "en", "cs", more).collect()  # "system" is refused, the phrase is not
    assert [(r.id, r.name, r.aliases, r.frequency) for r in enum] == [("term_0000", "system call", ["system call"], 4), ("term_0001", "call", ["call"], 3)]
    empty = vocab.corpus_frequencies(spark.createDataFrame([], "t string"), "t")
    assert vocab.corpus_enum(empty, 0).count() == 0 and vocab.corpus_enum(empty, 0, "zh", "psychology").count() == 36


def test_corpus_frequencies_form_terms_within_the_row(spark):
    """The rows' terms are those of ``corpus_terms``, in the form of ``corpus_form``; no row a term is shuffled."""
    texts = ["It's a s gas, s glass' classes", "a_b_ __ _s cats_ s", "計算機s 系统 ab1 系统s", "Été ÉTÉS straßen 10s ² Ⅷs İs ΑΣ", "s s", "s", "a b as", "", None, "cats cat cats"]
    df = spark.createDataFrame(enumerate(texts), "i int, t string")
    for language in ("en", "zh"):
        want = df.select("i", F.explode(vocab.corpus_terms(F.col("t"), language)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("i").alias("df"))
        freq = vocab.corpus_frequencies(df, "t", language)
        assert sorted(map(tuple, freq.collect())) == sorted(map(tuple, want.collect()))
        assert "Generate" not in freq._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.term: (r.tf, r.df) for r in vocab.corpus_frequencies(df.where("i = 0"), "t").collect()}
    assert rows["it"] == (2, 1) and "it " not in rows  # "it s" is "it" in its form
    pairs = spark.createDataFrame([("it s",), ("a s",), ("gas s",), ("as s",)], "x string")
    assert [r.c for r in pairs.select(vocab.corpus_form(F.col("x")).alias("c")).collect()] == [vocab._form(r.x) for r in pairs.collect()] == ["it", "a s", "gas", "as"]


def test_labels_do_not_shuffle_barred_terms(spark):
    freq = spark.createDataFrame([("rare one", 9, 1), ("good term", 5, 4), ("often term", 50, 9)], "term string, tf long, df long")
    more = spark.createDataFrame([("rare ones",), ("new term",), ("new term",), ("new term",), ("good term",), ("often terms",)], "term string")
    enum = vocab.corpus_enum(freq, 10, "en", "cs", more)
    assert [(r.name, r.frequency) for r in enum.collect()] == [("good term", 6)]
    plan = enum._jdf.queryExecution().optimizedPlan().toString()
    assert "df" in plan[plan.index("Union") :] and "Filter" in plan[plan.index("Union") :].split("Aggregate")[0]


def test_fuzzy_compares_within_the_row(spark):
    """Against every pair; labels are shuffled to be distinct and for their best name, their bigrams never."""
    names = ["memory", "memories", "network", "networks", "aa", "b", "queue", "queues", "abcdefghij"]
    labels = ["memory", "memorys", "memorie", "networkz", "aaa", "aa", "a", "b", "", None, "queued", "quque", "abcdefghijk", "xyz", "memory"]
    enum, rows = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(x,) for x in labels], "label string")
    both = rows.where("length(label) > 1").distinct().crossJoin(enum).select("label", "name", F.round(T.bigram_similarity(F.col("label"), F.col("name")), 6).alias("s"))
    for threshold in (0.7, 0.9):
        want = {}
        for r in sorted(both.where(F.col("s") >= threshold).collect(), key=lambda r: (-r.s, r.name)):
            want.setdefault(r.label, (r.label, r.name, r.s))
        got = vocab.fuzzy(rows, enum, threshold)
        assert want and sorted(map(tuple, got.collect())) == sorted(want.values())
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("held", [5, 1000])
def test_contained_joins_no_words(spark, held):
    """Against a join on every word; texts and pairs are not shuffled where identifiers come once."""
    words = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(words[:10])), (1, " ".join(words[2:])), (2, "W3 w4, w3"), (3, ""), (4, None), (None, "w1 w2"), (5, " ".join(words))], "item_id long, text string")
    texts = [(i, " ".join(words[: i + 3] + ["other"] * i)) for i in range(10)] + [(20, None), (21, ""), (22, " ".join(words[1:11])), (None, "w2 w1")]
    once = spark.createDataFrame(texts, "doc_id long, text string")
    twice = once.union(spark.createDataFrame([(0, "w5 w6 w7 w8"), (0, "w9"), (None, "w1")], "doc_id long, text string"))
    each = lambda df: df.select(df.columns[0], F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("w"))
    for docs in (once, twice):
        pairs = each(docs).select("doc_id", F.explode("w").alias("t")).join(each(items).select("item_id", F.size("w").alias("n"), F.explode("w").alias("t")), "t")
        want = pairs.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("shared")).where("shared >= n * 0.9D")
        got = vocab.contained(docs, items, 0.9, held=held)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) != []
    assert "Exchange" not in vocab.contained(once, items, 0.9)._jdf.queryExecution().executedPlan().toString()


def test_lists_and_categories(spark):
    assert "figure q" in lexicon.denylist() and "system" not in lexicon.denylist() and "system" in lexicon.denylist("en", "cs") and "系统" in lexicon.denylist("zh")
    assert "操作系统" in lexicon.allowed("zh", "cs") and lexicon.allowed("zh", "math") == []
    terms = ["secret plan", "secret", "plan", "note", "Lao Li", "王小明", "happy/sad", "", "   ", None]
    got = [r.c for r in spark.createDataFrame([(t,) for t in terms], "x string").select(lexicon.concept_category(F.col("x")).alias("c")).collect()]
    assert got == ["mental_state", "social_act", "mental_state", "context_place", "context_name", "context_name", "emotion", "other", "other", "other"]
    cleaned = one(spark, ["信念的", "信念", "他在哪里", "公园", "小公园", "的", " ", None], lexicon.clean_concept_terms, "array<string>")
    assert cleaned == ["信念", "小公园", "的"]
    assert one(spark, None, lexicon.clean_concept_terms, "array<string>") is None


def test_reanswer(spark):
    def oracle(prompts, tokens):
        if "down" in prompts:
            raise RuntimeError("no connection")
        return [RuntimeError("output limit reached") if p == "long" else RuntimeError("refused") if p == "bad" else " " if p == "blank" and t < 2048 else "ok" for p, t in zip(prompts, tokens, strict=True)]

    df = spark.createDataFrame([(1, "fine", 512), (2, "long", 4096), (3, "bad", 512), (4, "blank", 512), (5, "blank", 8192)], "id int, prompt string, budget int").coalesce(1)
    got = {r.id: (r.raw_output, r.calls, r.max_tokens, r.call_error) for r in responses.reanswer(df, "prompt", "budget", oracle).collect()}
    assert got == {1: ("ok", 1, 512, None), 2: (None, 3, 8192, "output limit reached"), 3: (None, 1, 512, "refused"), 4: ("ok", 3, 2048, None), 5: ("ok", 1, 8192, None)}
    down = responses.reanswer(df.withColumn("prompt", F.lit("down")), "prompt", "budget", oracle).collect()
    assert {(r.calls, r.call_error) for r in down} == {(1, "no connection")}
    assert responses.reanswer(df.limit(0), "prompt", "budget", oracle).count() == 0


def test_answer_record_defaults(spark):
    df = spark.createDataFrame([("q1", None, "boom")], "id string, is_correct boolean, call_error string")
    got = responses.answer_record(df, "set", {"key": "d", "model": "m"}, {"key": "a", "name": "n"}).first()
    assert (got.dataset, got.designer_model, got.question_id, got.is_correct, got.soft_score, got.gold_answer) == ("set", "m", "q1", False, 0.0, None)


ODD = [(1, "Cats cat_s  class_ the__cats Şırnak İs ab's été", "x"), (2, None, "x"), (3, "記憶體 内存s 小明_x cats cats", "x"), (4, "", "x"), (1, "cats ss s' ²x Ⅷ", "x"), (None, "cats dogs", "x")]


def test_words_of_repeated_identifiers_count_once(spark, monkeypatch):
    df = spark.createDataFrame([*ODD, (None, "dogs", "x"), (1, "cats", "x")], "doc_id int, text string, source string")
    want = sorted(vocab.frequencies(vocab.terms(df, "doc_id", "text"), "doc_id").collect())
    for held in (1, 1000):
        monkeypatch.setattr(vocab, "HELD", held)
        assert sorted(vocab.word_frequencies(df, "doc_id", "text").collect()) == want


def test_names_within_words(spark):
    texts = ["Concatenate the CATS", "cat-s", None, "", "x" * 70 + "cat" + "y" * 70, "ca t1"]
    names = ["cat", "cats", "ate", "xc", "t1"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", vocab.held_terms(names)(F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in rows} == {t: sum(n in (t or "").lower() for n in names) for t in texts}
