"""The driver's tables in the roles of the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by(keys: str, *order: str) -> WindowSpec:
    """A window over the rows of a key in order."""
    return Window.partitionBy(keys).orderBy(*order)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("lang").alias("language"), F.col("source").alias("domain"), "n_chars")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("question_id"),
        F.split("text", "\n")[0].alias("stem"),
        F.col("source").alias("super_parent"),
        F.when(F.col("toxic") == 1, "adversarial").otherwise("standard").alias("design_type"),
        F.concat(F.lit("L"), (F.col("n_chars") % 5 + 1).cast("string")).alias("difficulty"),
        F.col("doc_id").alias("generation_index"),
        (F.col("n_chars") % 700).alias("secs"),
        "quality",
        "n_chars",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.col("user_id") % 8
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.col("event_id") / 4).cast("long").alias("question_id"),
        F.concat(F.lit("m"), lane.cast("string")).alias("answer_model"),
        (lane < 4).alias("is_strong"),
        F.col("event_type").alias("designer_model"),
        F.when(F.col("value") >= 2, F.col("value") >= 40).alias("is_correct"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("soft_score"),
        "value",
    )


ITEMS = "v_items as (select doc_id id, text question, lang \"language\", source \"domain\", n_chars from documents)"
QUESTIONS = """v_questions as (select d.doc_id question_id, string_split(text, chr(10))[1] stem, source super_parent,
 case when toxic = 1 then 'adversarial' else 'standard' end design_type, 'L' || (n_chars % 5 + 1)::varchar difficulty,
 d.doc_id generation_index, n_chars % 700 secs, quality, n_chars from documents d left join labels l on l.doc_id = d.doc_id)"""
ANSWERS = """v_answers as (select event_id, floor(event_id / 4)::bigint question_id, 'm' || (user_id % 8)::varchar answer_model, user_id % 8 < 4 is_strong,
 event_type designer_model, case when value >= 2 then value >= 40 end is_correct, least(value / 200, 1.0::double) soft_score, value from events)"""
