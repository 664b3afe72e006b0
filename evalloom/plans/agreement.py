"""Queries over several extraction runs of the same items: agreement, stability index, consensus, quality.

The runs are real ones: what a user's events show on three days in turn are three runs over the user.
Their pages and counters are the terms, their kinds the subdomains.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import jsonx as J
from evalloom.operators import stability
from evalloom.operators.views import read
from evalloom.plans.registry import query
from evalloom.plans.texts import nsi_sql

RUNS = """e as (select user_id item, dayofyear(ts) % 3 run, event_type, value, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k')) w from events where user_id is not null),
 u as (select item, run, list_sort(list_distinct(list(event_type) filter (event_type is not null))) subdomains, list_sort(list_distinct(list(event_type || ':' || right(w, 1)) filter (event_type || w is not null))) terms, avg(value) / 200 confidence, bool_or(event_type <> 'error') is_valid from e group by 1, 2),
 runs as (select item, run, coalesce(subdomains, []) subdomains, coalesce(terms, []) terms, confidence, coalesce(is_valid, false) is_valid from u)"""
PAIRS = f"""{RUNS}, pairs as (select x.item, x.run run_a, y.run run_b, x.is_valid and y.is_valid valid, x.subdomains sa, y.subdomains sb, x.terms ta, y.terms tb from runs x join runs y on x.item = y.item and x.run < y.run)"""
JAC = "case when valid then coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 1) end"
PARENTS = {"click": "action", "purchase": "action", "view": "visit", "signup": "visit"}
UP = "list_distinct(list_transform({c}, lambda t: case t " + " ".join(f"when '{k}' then '{v}'" for k, v in PARENTS.items()) + " else t end))"
AGREED = f"""{PAIRS}, agreed as (select item, run_a, run_b, {JAC.format(a="sa", b="sb")} raw_jaccard_subdomains, {JAC.format(a="ta", b="tb")} raw_jaccard_terms, {JAC.format(a=UP.format(c="sa"), b=UP.format(c="sb"))} hierarchical_agreement from pairs)"""
METRICS = f"""{AGREED}, metrics as (select run_a, run_b, count(raw_jaccard_terms) items, avg(raw_jaccard_subdomains) raw_jaccard_subdomains, avg(raw_jaccard_terms) raw_jaccard_terms, avg(hierarchical_agreement) hierarchical_agreement from agreed group by 1, 2)"""


def runs(spark, sf):
    """item, run, subdomains, terms, confidence, is_valid."""
    v = J.json_blob(F.col("props"))
    rows = read(spark, sf, "events").where("user_id is not null").select(F.col("user_id").alias("item"), (F.dayofyear("ts") % 3).cast("long").alias("run"), "event_type", "value", F.coalesce(J.path(v, "page"), J.path(v, "k")).alias("w"))
    term = F.concat("event_type", F.lit(":"), F.right("w", F.lit(1)))
    return rows.groupBy("item", "run").agg(
        F.array_sort(F.collect_set("event_type")).alias("subdomains"), F.array_sort(F.collect_set(term)).alias("terms"), (F.avg("value") / 200).alias("confidence"), F.coalesce(F.bool_or(F.col("event_type") != "error"), F.lit(False)).alias("is_valid")
    )


def _agreed(spark, sf, soft=False):
    parents = F.create_map(*(F.lit(x) for pair in PARENTS.items() for x in pair))
    return stability.pair_agreement(stability.run_pairs(runs(spark, sf)), parents, soft)


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in stability.MEASURES else F.col(c) for c in df.columns))


R6 = ", ".join(f"round({m}, 6) {m}" for m in stability.MEASURES[:3])


@query("run_agreement_pairs", f"with {AGREED} select item, run_a, run_b, {R6} from agreed")
def run_agreement_pairs(spark, sf):
    return _rounded(_agreed(spark, sf))


@query("run_pair_metrics", f"with {METRICS} select run_a, run_b, items, {R6} from metrics")
def run_pair_metrics(spark, sf):
    return _rounded(stability.pair_metrics(_agreed(spark, sf)))


FLOORS = "list_sort(list_filter([" + ", ".join(f"case when coalesce({m} < {f}, true) then '{m}' end" for m, f in (("nsi", 0.65), ("hierarchical_agreement", 0.80))) + "], lambda x: x is not null))"


@query("run_mean_metrics", f"with {METRICS} select count(*) pairs, {', '.join(f'round(avg({m}), 6) {m}' for m in stability.MEASURES[:3])} from metrics")
def run_mean_metrics(spark, sf):
    return stability.mean_metrics(stability.pair_metrics(_agreed(spark, sf)))


@query("run_soft_agreement")
def run_soft_agreement(spark, sf):
    """With the soft measures, whose assignment SQL does not express."""
    return _rounded(stability.pair_metrics(_agreed(spark, sf, soft=True)))


ALIGNED = f"with {PAIRS}, z as (select item id, ta a, tb b from pairs where valid and run_a = 0 and run_b = 1)"


def _aligned(spark, sf):
    pairs = stability.run_pairs(runs(spark, sf)).where("valid and run_a = 0 and run_b = 1")
    return pairs.select(F.col("item").alias("id"), F.col("a.terms").alias("a"), F.col("b.terms").alias("b"))


@query("run_nsi", nsi_sql(ALIGNED))
def run_nsi(spark, sf):
    return stability.nsi(_aligned(spark, sf))


@query("run_floors", f"with m as (select * from ({nsi_sql(ALIGNED)})), h as (select hierarchical_agreement from ({f'with {METRICS} select * from metrics where run_a = 0 and run_b = 1'})) select nsi, round(hierarchical_agreement, 6) hierarchical_agreement, array_to_string({FLOORS}, ',') failed from m, h")
def run_floors(spark, sf):
    """Which measures of the first two runs stay below their floors."""
    pair = stability.pair_metrics(_agreed(spark, sf)).where("run_a = 0 and run_b = 1").select(F.lit(0).alias("k"), "hierarchical_agreement")
    rows = stability.nsi(_aligned(spark, sf)).select(F.lit(0).alias("k"), "nsi").join(pair, "k")  # a row each
    return rows.select("nsi", F.round("hierarchical_agreement", 6).alias("hierarchical_agreement"), F.array_join(stability.failed_floors(rows, {"nsi": 0.65, "hierarchical_agreement": 0.80}), ",").alias("failed"))


def _consensus_sql(c: str, most: int) -> str:
    every = f"list_reduce({c}, lambda s, x: list_intersect(s, x))"
    return f"array_to_string(case when runs = 0 then [] when runs = 1 then {c}[1] else list_sort(list_concat(list_sort({every}), list_sort(list_filter(list_distinct(flatten({c})), lambda t: not list_contains({every}, t))))[1:{most}]) end, ',') {c}"


@query("run_consensus", f"""with {RUNS}, g as (select item, count(*) filter (is_valid) runs, avg(confidence) filter (is_valid) confidence, list(subdomains order by run) filter (is_valid) subdomains, list(terms order by run) filter (is_valid) terms from runs group by 1)
 select item, runs, {_consensus_sql("subdomains", 3)}, {_consensus_sql("terms", 12)}, round(coalesce(confidence, 0), 6) confidence, runs > 0 is_valid from g""")
def run_consensus(spark, sf):
    rows = stability.run_consensus(runs(spark, sf))
    return rows.withColumns({"subdomains": F.array_join("subdomains", ","), "terms": F.array_join("terms", ","), "confidence": F.round("confidence", 6)})


@query("run_quality", f"""with {RUNS}, q as (select *, len(list_filter(terms, lambda t: contains(t, 'click') or contains(t, 'view'))) anchored from runs where run = 0),
 m as (select round(coalesce(avg(is_valid::int::double), 0), 6) coverage, round(least(coalesce(sum(anchored) / nullif(sum(len(terms)), 0), 0), 1), 6) anchored_percent, round(1 - count(distinct terms) / count(*), 6) duplicate_share from q)
 select *, array_to_string(list_sort(list_filter([case when coverage < 0.95 then 'coverage' end, case when anchored_percent < 0.5 then 'anchored_percent' end], lambda x: x is not null)), ',') failed from m""")
def run_quality(spark, sf):
    """Coverage, anchored share and equal term sets of the first run, with the floors it misses."""
    anchored = F.size(F.filter("terms", lambda t: t.contains("click") | t.contains("view")))
    rows = stability.quality(runs(spark, sf).where("run = 0").withColumn("anchored_count", anchored)).drop("modality_fidelity")
    return rows.withColumn("failed", F.array_join(stability.failed_floors(rows, stability.QUALITY), ","))
