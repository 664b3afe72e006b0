"""Answer-panel analytics: accuracy matrices, dynamic quality, item and designer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.mathx import pearson

# Evidence needed and bounds of the dynamic rules.
MIN_TOTAL, MIN_STRONG = 3, 2
DISAGREE, EASY, HARD = 0.4, 0.95, 0.05
BLOCK = 50


def accuracy(df: DataFrame, *keys: str) -> DataFrame:
    """correct, total, accuracy by any keys; rows without a verdict are skipped."""
    return df.where(F.col("is_correct").isNotNull()).groupBy(*keys).agg(F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def accuracy_sets(df: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Several matrices from one pass; a key that a matrix lacks is null, and ``matrix`` is its number."""
    rows = df.where(F.col("is_correct").isNotNull())
    view = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    names = F.concat_ws("+", *(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))
    return view.agg(names.alias("matrix"), F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def soft_matrix(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(F.col("soft_score").isNotNull()).groupBy(*keys).agg(F.round(F.avg("soft_score"), 6).alias("soft"), F.count(F.lit(1)).alias("n"))


def hard_soft(df: DataFrame, model: str = "answer_model") -> DataFrame:
    return df.groupBy(model).agg(
        F.count("is_correct").alias("hard_total"), F.count_if("is_correct").alias("hard_correct"), F.count("soft_score").alias("soft_total"), F.round(F.avg("soft_score"), 6).alias("soft_mean")
    ).withColumn("hard_accuracy", F.round(F.try_divide("hard_correct", "hard_total"), 6))


def nested(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Long form to a map per outer key."""
    return df.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, value)))).alias("by_" + inner))


def question_stats(df: DataFrame) -> DataFrame:
    total, strong = F.count(F.lit(1)), F.count_if("is_strong")
    return df.groupBy("question_id").agg(total.alias("total_answers"), F.count_if("is_correct").alias("correct_total"), strong.alias("strong_total"), F.count_if(F.col("is_strong") & F.col("is_correct")).alias("strong_correct")).select(
        "*", F.round(F.col("correct_total") / F.col("total_answers"), 6).alias("overall_rate"), F.round(F.try_divide("strong_correct", "strong_total"), 6).alias("strong_rate")
    )


def dynamic_flags() -> Column:
    """Flags over the columns of ``question_stats``, sorted."""
    enough = F.col("total_answers") >= MIN_TOTAL
    strong = enough & (F.col("strong_total") >= MIN_STRONG)
    rate, all_ = F.col("strong_correct") / F.nullif("strong_total", F.lit(0)), F.col("correct_total") / F.col("total_answers")
    flags = F.array(
        F.when(strong & (F.col("strong_correct") == 0), "all_strong_fail"),
        F.when(strong & (rate > 0) & (rate < DISAGREE), "strong_disagreement"),
        F.when(enough & (all_ > EASY), "too_easy"),
        F.when(enough & (all_ < HARD), "too_hard"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def should_judge(flags: Column, base_status: Column, design: Column) -> Column:
    """Which questions merit a judge; an adversarial one that is only too hard does not."""
    has = lambda f: F.array_contains(flags, f)
    lone = has("too_hard") & (F.lower(design) == "adversarial") & ~has("all_strong_fail") & ~has("strong_disagreement")
    suspicious = has("all_strong_fail") | has("strong_disagreement") | (has("too_hard") & ~lone)
    return (base_status != "broken_static") & (F.col("total_answers") >= MIN_TOTAL) & (F.col("strong_total") >= MIN_STRONG) & ~has("too_easy") & suspicious


def final_status(status: Column, judge: Column) -> Column:
    """Static and skipped states stay; a judge's label decides; a candidate is clean."""
    return F.when(status.isin("broken_static", "skip_core"), status).when(judge == "broken", "broken").when(judge == "ambiguous", "ambiguous").when(status == "candidate", "clean").otherwise(status)


def ability(df: DataFrame) -> DataFrame:
    return accuracy(df, "answer_model").select("answer_model", F.col("accuracy").alias("ability"))


def item_stats(df: DataFrame) -> DataFrame:
    """p_correct, discrimination (correlation of ability and correctness), number of models."""
    scored = df.where(F.col("is_correct").isNotNull()).join(F.broadcast(ability(df)), "answer_model")
    x = scored.withColumn("hit", F.col("is_correct").cast("double"))
    return x.groupBy("designer_model", "question_id").agg(F.round(F.avg("hit"), 6).alias("p_correct"), F.round(pearson("ability", "hit"), 6).alias("discrimination"), F.countDistinct("answer_model").alias("n_models"))


def designer_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("designer_model").agg(F.round(F.avg("p_correct"), 6).alias("mean_p"), F.round(F.coalesce(F.avg("discrimination"), F.lit(0.0)), 6).alias("mean_discrimination"), F.count(F.lit(1)).alias("n_items"))


def family_bias(df: DataFrame, answer_family: Column, designer_family: Column) -> DataFrame:
    own = answer_family == designer_family
    hit = F.col("is_correct").cast("double")
    return df.where(F.col("is_correct").isNotNull()).groupBy("answer_model").agg(F.round(F.avg(F.when(own, hit)), 6).alias("own_accuracy"), F.round(F.avg(F.when(~own, hit)), 6).alias("other_accuracy")).withColumn(
        "bias", F.round(F.col("own_accuracy") - F.col("other_accuracy"), 6)
    )


def block(c: Column, size: int = BLOCK) -> Column:
    """First index of a block of questions, from 1."""
    return (F.floor(c / size) * size + 1).cast("long")
