"""Queries over the answer panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.functions.mathx import scoring_profile, soft_score
from evalloom.operators import panel, views
from evalloom.operators.views import ANSWERS, QUESTIONS
from evalloom.plans.registry import query

ACC = "count(*) filter (where is_correct) correct, count(*) total, round(count(*) filter (where is_correct) / count(*), 6) accuracy"


@query("accuracy_global", f"with {ANSWERS} select answer_model, designer_model, {ACC} from v_answers where is_correct is not null group by 1, 2")
def accuracy_global(spark, sf):
    return panel.accuracy(views.answers(spark, sf), "answer_model", "designer_model")


@query("accuracy_by_design", f"with {ANSWERS}, {QUESTIONS} select answer_model, design_type, {ACC} from v_answers a join v_questions q on q.question_id = a.question_id where is_correct is not null group by 1, 2")
def accuracy_by_design(spark, sf):
    q = views.questions(spark, sf).select("question_id", "design_type")
    return panel.accuracy(views.answers(spark, sf).join(q, "question_id"), "answer_model", "design_type")


@query("accuracy_by_difficulty", f"with {ANSWERS}, {QUESTIONS} select answer_model, difficulty, {ACC} from v_answers a join v_questions q on q.question_id = a.question_id where is_correct is not null group by 1, 2")
def accuracy_by_difficulty(spark, sf):
    q = views.questions(spark, sf).select("question_id", "difficulty")
    return panel.accuracy(views.answers(spark, sf).join(q, "question_id"), "answer_model", "difficulty")


@query("accuracy_grouping_sets", f"""with {ANSWERS}, g as (select answer_model, designer_model, is_strong, grouping(answer_model) g1, grouping(designer_model) g2, grouping(is_strong) g3, {ACC}
 from v_answers where is_correct is not null group by grouping sets ((answer_model, designer_model), (answer_model), (designer_model), (is_strong), ()))
 select answer_model, designer_model, is_strong, concat_ws('+', case when g1 = 0 then 'answer_model' end, case when g2 = 0 then 'designer_model' end, case when g3 = 0 then 'is_strong' end) matrix, correct, total, accuracy from g""")
def accuracy_grouping_sets(spark, sf):
    return panel.accuracy_sets(views.answers(spark, sf), ["answer_model", "designer_model", "is_strong"], [["answer_model", "designer_model"], ["answer_model"], ["designer_model"], ["is_strong"], []])


@query("soft_matrix", f"with {ANSWERS} select answer_model, designer_model, round(avg(soft_score), 6) soft, count(*) n from v_answers where soft_score is not null group by 1, 2")
def soft_matrix(spark, sf):
    return panel.soft_matrix(views.answers(spark, sf), "answer_model", "designer_model")


@query("per_model_hard_soft", f"""with {ANSWERS} select answer_model, count(is_correct) hard_total, count(*) filter (where is_correct) hard_correct, count(soft_score) soft_total, round(avg(soft_score), 6) soft_mean,
 round(count(*) filter (where is_correct) / nullif(count(is_correct), 0), 6) hard_accuracy from v_answers group by 1""")
def per_model_hard_soft(spark, sf):
    return panel.hard_soft(views.answers(spark, sf))


@query("nested_matrix", f"""with {ANSWERS}, a as (select answer_model, designer_model, {ACC} from v_answers where is_correct is not null group by 1, 2)
 select answer_model, string_agg(designer_model || '=' || correct || '/' || total, ',' order by designer_model) by_designer from a group by 1""")
def nested_matrix(spark, sf):
    acc = panel.accuracy(views.answers(spark, sf), "answer_model", "designer_model").withColumn("cell", F.concat("correct", F.lit("/"), "total"))
    m = panel.nested(acc, "answer_model", "designer_model", "cell")
    return m.select("answer_model", F.array_join(F.transform(F.array_sort(F.map_entries("by_designer_model")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("by_designer"))


STATS = f"""{ANSWERS}, s as (select question_id, count(*) total_answers, count(*) filter (where is_correct) correct_total, count(*) filter (where is_strong) strong_total, count(*) filter (where is_strong and is_correct) strong_correct from v_answers group by 1),
 f as (select *, list_filter([case when total_answers >= 3 and strong_total >= 2 and strong_correct = 0 then 'all_strong_fail' end,
 case when total_answers >= 3 and strong_total >= 2 and strong_correct > 0 and strong_correct / strong_total < 0.4::double then 'strong_disagreement' end,
 case when total_answers >= 3 and correct_total / total_answers > 0.95::double then 'too_easy' end, case when total_answers >= 3 and correct_total / total_answers < 0.05::double then 'too_hard' end], lambda x: x is not null) f from s)"""


@query("question_stats", f"with {STATS} select question_id, total_answers, correct_total, strong_total, strong_correct, round(correct_total / total_answers, 6) overall_rate, round(strong_correct / nullif(strong_total, 0), 6) strong_rate from s")
def question_stats(spark, sf):
    return panel.question_stats(views.answers(spark, sf))


@query("dynamic_flags", f"with {STATS} select question_id, total_answers, strong_total, array_to_string(f, ',') flags from f")
def dynamic_flags(spark, sf):
    return panel.question_stats(views.answers(spark, sf)).select("question_id", "total_answers", "strong_total", F.array_join(panel.dynamic_flags(), ",").alias("flags"))


JUDGE = f"""{STATS}, {QUESTIONS}, j as (select f.*, coalesce(q.design_type, 'standard') design_type from f left join v_questions q on q.question_id = f.question_id),
 k as (select *, total_answers >= 3 and strong_total >= 2 and not list_contains(f, 'too_easy') and (list_contains(f, 'all_strong_fail') or list_contains(f, 'strong_disagreement')
 or (list_contains(f, 'too_hard') and not design_type = 'adversarial')) judge from j)"""


def _judged(spark, sf):
    q = views.questions(spark, sf).select("question_id", "design_type")
    rows = panel.question_stats(views.answers(spark, sf)).withColumn("f", panel.dynamic_flags()).join(q, "question_id", "left").withColumn("design_type", F.coalesce("design_type", F.lit("standard")))
    return rows.withColumn("judge", panel.should_judge(F.col("f"), F.lit("candidate"), F.col("design_type")))


@query("judge_candidates", f"with {JUDGE} select question_id, design_type, array_to_string(f, ',') flags from k where judge")
def judge_candidates(spark, sf):
    return _judged(spark, sf).where("judge").select("question_id", "design_type", F.array_join("f", ",").alias("flags"))


@query("final_status", f"""with {JUDGE}, v as (select question_id, judge, case when judge and list_contains(f, 'all_strong_fail') then 'broken' when judge and list_contains(f, 'strong_disagreement') then 'ambiguous' end label from k)
 select question_id, judge, case when label = 'broken' then 'broken' when label = 'ambiguous' then 'ambiguous' else 'clean' end status from v""")
def final_status(spark, sf):
    label = F.when(F.col("judge") & F.array_contains("f", "all_strong_fail"), "broken").when(F.col("judge") & F.array_contains("f", "strong_disagreement"), "ambiguous")
    return _judged(spark, sf).select("question_id", "judge", panel.final_status(F.lit("candidate"), label).alias("status"))


@query("write_back_stats", f"with {STATS} select a.event_id, a.question_id, a.answer_model, s.total_answers, s.strong_total from v_answers a join s on s.question_id = a.question_id")
def write_back_stats(spark, sf):
    a = views.answers(spark, sf)
    return a.select("event_id", "question_id", "answer_model").join(panel.question_stats(a).select("question_id", "total_answers", "strong_total"), "question_id").select("event_id", "question_id", "answer_model", "total_answers", "strong_total")


ITEM_STATS = f"""{ANSWERS}, ab as (select answer_model, round(count(*) filter (where is_correct) / count(*), 6) ability from v_answers where is_correct is not null group by 1),
 x as (select a.*, ab.ability, case when is_correct then 1.0::double else 0.0::double end hit from v_answers a join ab on ab.answer_model = a.answer_model where is_correct is not null),
 i as (select designer_model, question_id, round(avg(hit), 6) p_correct, case when count(*) >= 2 then round(covar_pop(ability, hit) / nullif(stddev_pop(ability) * stddev_pop(hit), 0), 6) end discrimination, count(distinct answer_model) n_models from x group by 1, 2)"""


@query("item_stats", f"with {ITEM_STATS} select * from i")
def item_stats(spark, sf):
    return panel.item_stats(views.answers(spark, sf))


@query("designer_stats", f"with {ITEM_STATS} select designer_model, round(avg(p_correct), 4) mean_p, round(coalesce(avg(discrimination), 0), 4) mean_discrimination, count(*) n_items from i group by 1")
def designer_stats(spark, sf):
    return panel.designer_stats(panel.item_stats(views.answers(spark, sf))).select("designer_model", F.round("mean_p", 4).alias("mean_p"), F.round("mean_discrimination", 4).alias("mean_discrimination"), "n_items")


FAMILY = "case when answer_model in ('m0', 'm1') then 'click' when answer_model in ('m2', 'm3') then 'view' when answer_model in ('m4', 'm5') then 'purchase' else 'other' end"


def _family():
    m = F.col("answer_model")
    return F.when(m.isin("m0", "m1"), "click").when(m.isin("m2", "m3"), "view").when(m.isin("m4", "m5"), "purchase").otherwise("other")


@query("family_bias", f"""with {ANSWERS}, b as (select answer_model, round(avg(is_correct::int) filter (where {FAMILY} = designer_model), 6) own_accuracy, round(avg(is_correct::int) filter (where {FAMILY} <> designer_model), 6) other_accuracy
 from v_answers where is_correct is not null group by 1) select *, round(own_accuracy - other_accuracy, 6) bias from b""")
def family_bias(spark, sf):
    return panel.family_bias(views.answers(spark, sf), _family(), F.col("designer_model"))


@query("family_matrix", f"with {ANSWERS} select {FAMILY} answer_family, designer_model designer_family, {ACC} from v_answers where is_correct is not null group by 1, 2")
def family_matrix(spark, sf):
    rows = views.answers(spark, sf).withColumn("answer_family", _family()).withColumn("designer_family", F.col("designer_model"))
    return panel.accuracy(rows, "answer_family", "designer_family")


@query("visual_mention", f"""with {QUESTIONS}, m as (select super_parent, regexp_matches(coalesce(stem, ''), '(?i)\\b(image|diagram|figure|picture|graph|chart|photo|draw|visual|the|of)\\b') mention, quality from v_questions)
 select mention, coalesce(quality, -1)::int quality, count(*) n from m group by 1, 2""")
def visual_mention(spark, sf):
    words = "|".join([*T.VISUAL_WORDS, "the", "of"])
    return views.questions(spark, sf).select(F.coalesce("stem", F.lit("")).rlike(rf"(?i)\b({words})\b").alias("mention"), F.coalesce("quality", F.lit(-1)).alias("quality")).groupBy("mention", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("generation_blocks", f"with {ANSWERS} select (floor(question_id / 50) * 50 + 1)::bigint block, {ACC} from v_answers where is_correct is not null group by 1")
def generation_blocks(spark, sf):
    return panel.accuracy(views.answers(spark, sf).withColumn("block", panel.block(F.col("question_id"))), "block")


@query("design_difficulty", f"""with {QUESTIONS} select design_type, difficulty, count(*) total, count(*) filter (where quality is null) skipped, coalesce(max(question_id) filter (where quality is null), -1) last_skipped from v_questions group by 1, 2""")
def design_difficulty(spark, sf):
    skip = F.col("quality").isNull()
    return views.questions(spark, sf).groupBy("design_type", "difficulty").agg(F.count(F.lit(1)).alias("total"), F.count_if(skip).alias("skipped"), F.coalesce(F.max(F.when(skip, F.col("question_id"))), F.lit(-1)).alias("last_skipped"))


@query("soft_score", f"""with {ANSWERS} select event_id, case when value > 190 then null else coalesce(case when event_id % 5 = 0 then soft_score end, case when is_correct then 1.0::double when not is_correct then 0.0::double end) end soft from v_answers""")
def soft_score_query(spark, sf):
    judge = F.when(F.col("event_id") % 5 == 0, F.col("soft_score"))
    method = F.when(F.col("value") > 190, "skip_core").otherwise("llm_judge")
    return views.answers(spark, sf).select("event_id", soft_score(judge, F.col("is_correct"), method).alias("soft"))


@query("designers_by_answerers", f"with {ANSWERS} select distinct d.designer_model, a.answer_model from (select distinct designer_model from v_answers) d, (select distinct answer_model from v_answers) a")
def designers_by_answerers(spark, sf):
    """All pairs of two short lists of models."""
    pair = views.answers(spark, sf).agg(F.collect_set("designer_model").alias("d"), F.collect_set("answer_model").alias("a"))
    return pair.select(F.explode("d").alias("designer_model"), "a").select("designer_model", F.explode("a").alias("answer_model"))


@query("scoring_profile", rf"""with {QUESTIONS}, g as (select question_id, question_id % 3 = 0 mcq, regexp_replace(coalesce(stem, ''), '^\s+|\s+$', '', 'g') g from v_questions),
 n as (select *, len(regexp_extract_all(lower(g), '[\p{{L}}\p{{N}}\p{{M}}_]+')) t, len(list_filter(string_split_regex(g, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) s from g)
 select question_id, case when mcq then 'mcq_exact' when regexp_matches(g, '^[\s\d\.,eE+\-*/^()]+$') then 'numeric_exact' when t <= 3 then 'symbolic_exact' when t > 80 or s > 3 then 'skip_core' else 'llm_judge' end profile from n""")
def scoring_profile_query(spark, sf):
    q = views.questions(spark, sf)
    kind = F.when(F.col("question_id") % 3 == 0, "mcq_single").otherwise("open_ended")
    return q.select("question_id", scoring_profile(kind, F.col("stem")).alias("profile"))
