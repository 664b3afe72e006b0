"""Readers, converters and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evalloom.sources import converters, readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_json_lines_and_arrays(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    array = write(tmp_path / "a.json", '[{"id": 1}, {"id": 2}]')
    assert readers.jsonl(spark, lines, "id long").count() == 2
    assert [readers.json_any(spark, p, "id long").count() for p in (lines, array)] == [2, 2]
    bad = write(tmp_path / "bad.jsonl", '{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        readers.jsonl(spark, bad, "id long").collect()
    good, corrupt = readers.quarantined(spark, bad, StructType([StructField("id", LongType())]))
    assert good.select("id").collect()[0].id == 1 and corrupt.count() == 1


def test_discovery(spark, tmp_path):
    for name in ("d_stage3_answers_x_vs_y.jsonl", "d_stage3_answers_x_vs_z.jsonl", "questions_1.jsonl"):
        write(tmp_path / name, '{"id": 1}\n')
    found = readers.answer_files(spark, str(tmp_path), "d", answerer="z")
    assert len(found) == 1
    rows = spark.read.json(found).select("id", F.col("_metadata.file_path").alias("_file"))
    r = readers.pair_models(rows).first()
    assert (r.designer, r.answerer) == ("x", "z")
    assert readers.question_file(spark, str(tmp_path)).endswith("questions_1.jsonl")
    assert readers.newest(spark, [str(tmp_path / "none"), str(tmp_path)], "*.jsonl").endswith("questions_1.jsonl")


def test_converters(spark):
    cs = spark.createDataFrame([("7", "(3). What?", "x", "", "z", None, "A,C", "en", "MCQ", "CS")], "ID string, question string, A string, B string, C string, D string, Answer string, Language string, Format string, Domain string")
    r = converters.cs(cs).first()
    assert (r.id, r.question, [o.letter for o in r.options], r.answer, r.language, r.background["domain"]) == ("7", "What?", ["A", "C"], ["A", "C"], "English", "CS")
    med = spark.createDataFrame([("m", "Q\nAnswer Choices: A", {"B": "b", "A": "a"}, "A", [("p.png",)])], "id string, question string, options map<string,string>, label string, images array<struct<image_path:string>>")
    r = converters.medical(med).first()
    assert (r.question, [o.letter for o in r.options], r.modality, r.images) == ("Q", ["A", "B"], "Multimodal", ["p.png"])
    math = spark.createDataFrame([("1", "２、 Area?", "A. 1; B. 2;", "B", "area", "")], "ID string, question string, option string, answer string, `knowledge concept` string, image_path string")
    r = converters.math(math).first()
    assert (r.question, [o.content for o in r.options], r.modality, r.images, r.background) == ("Area?", ["1", "2"], "Text", [], {"concept": "area"})
    item = converters.math(math).select(converters.item_text().alias("t")).first().t
    assert "Question: Area?" in item and "A. 1" in item


def test_bilingual(spark):
    df = spark.createDataFrame([("1", "s", "q", "a", "nan", "A", "故事", "问", "甲", "乙", "B")], "id string, s string, q string, oa string, ob string, an string, zs string, zq string, za string, zb string, zan string")
    cols = lambda s, q, a, b, n: {"story": s, "question": q, "A": a, "B": b, "C": b, "D": b, "answer": n}
    rows = converters.bilingual(df, {"English": cols("s", "q", "oa", "ob", "an"), "Chinese": cols("zs", "zq", "za", "zb", "zan")}).collect()
    got = {r.language: r for r in rows}
    assert [o.letter for o in got["English"].options] == ["A"] and len(got["Chinese"].options) == 4
    assert got["Chinese"].context.story == "故事"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "id string, tags array<string>")
    sinks.human_eval(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().tags == "x; y"
    root = str(tmp_path / "table")
    sinks.version(df, root, "1")
    sinks.version(df.union(df), root, "2")
    assert sinks.current(spark, root).count() == 2
    sinks.sample(df, str(tmp_path / "s"), {"n": 1})
    assert readers.jsonl(spark, str(tmp_path / "s"), "id string").first().id == "a"


def test_images(spark):
    df = spark.createDataFrame([("a", "old/x.png"), ("b", "old/y.png")], "id string, image string")
    have = spark.createDataFrame([("new/x.png",)], StructType([StructField("path", StringType())]))
    assert [r.id for r in readers.images(df, have, rules=[("old/", "new/")]).collect()] == ["a"]
