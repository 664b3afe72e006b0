"""The boundary to models, batch files and repair passes."""

from pyspark.sql import functions as F

from evalloom.operators import responses as R
from evalloom.schemas import BATCH_LINE


def test_ask_keeps_rows_that_fail(spark):
    def oracle(prompts):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, prompt string").coalesce(1)
    got = {r.id: (r.raw_output, r.call_error) for r in R.ask(df, "prompt", oracle, batch=1).collect()}
    assert got == {1: ("A", None), 2: (None, "refused"), 3: ("C", None)}
    one = spark.createDataFrame([(None, " ", "x")], "a string, b string, c string")
    assert one.select(R.fallback(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "x"


def test_batches(spark):
    ok = lambda t: ("succeeded", ([("text", t), ("other", "x")],))
    lines = spark.createDataFrame([("b1", ok('```json\n[{"q": 1}, {"q": 2}, {"q"')), ("b2", ("errored", None)), ("b9", ok('[{"q": 3}]'))], BATCH_LINE)
    plan = spark.createDataFrame([("b1",), ("b2",)], "custom_id string")
    got = R.batch_questions(R.batch_text(lines), plan).collect()
    assert [(r.custom_id, r.position, r.question) for r in got] == [("b1", 0, '{"q": 1}'), ("b1", 1, '{"q": 2}')]


def test_backfill_and_rerun(spark):
    rows = spark.createDataFrame(
        [(1, "llm_judge", None, None, "x", None), (2, "llm_judge", 0.2, False, "x", None), (3, "numeric_exact", None, True, "x", None), (4, "skip_core", None, None, "", "e")],
        "id long, scoring_method string, judge_score double, is_correct boolean, raw_output string, call_error string",
    )
    verdicts = spark.createDataFrame([(1, '{"label": "correct", "score": 0.95}'), (2, '{"score": 1.0}')], "id long, raw string")
    got = {r.id: (r.judge_score, r.is_correct, r.soft_score) for r in R.backfill(rows, verdicts, ["id"]).collect()}
    assert got == {1: (0.95, True, 0.95), 2: (0.2, False, 0.2), 3: (None, True, 1.0), 4: (None, None, None)}
    again = rows.withColumn("parsed_answer", F.col("raw_output")).withColumn("parsed_set", F.lit(None).cast("array<string>")).where(R.needs_rerun())
    assert [r.id for r in again.collect()] == [4]


def test_hygiene(spark):
    df = spark.createDataFrame([(["Cache", "gone", "cache"], "a cache and a heap", ["stack", "heap"])], "t array<string>, x string, g array<string>")
    assert df.select(R.hygiene(F.col("t"), F.col("x"), F.col("g")).alias("h")).first().h == ["Cache", "heap", "cache"]
    parsed = R.parsed(spark.createDataFrame([(" b. ", "mcq_single"), ("A and c", "mcq_multi"), (" 42 ", "open_ended")], "raw_output string, question_type string")).collect()
    assert [(r.parsed_answer, r.parsed_set) for r in parsed] == [("B", None), (None, ["A", "C", "D"]), ("42", None)]
