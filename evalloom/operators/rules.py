"""Declarative rules: each is a condition and what it yields; results are arrays, exploded where rows are wanted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import HAN, is_chinese, normalize_stem, trim_ws


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column
    severity: str = "error"
    field: str = ""
    message: str = ""


def flags(rules: list[Rule]) -> Column:
    """Sorted distinct names of the rules that hold."""
    hits = F.filter(F.array(*(F.when(r.when, F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(hits))


def issues(df: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """One row for each rule that an item breaks: item_id, severity, category, message, field."""
    one = lambda r: F.when(r.when, F.struct(F.lit(r.severity).alias("severity"), F.lit(r.name).alias("category"), F.lit(r.message).alias("message"), F.lit(r.field).alias("field")))
    found = F.filter(F.array(*map(one, rules)), lambda x: x.isNotNull())
    return df.select(F.col(id_col).alias("item_id"), F.inline(found))


def item_rules(language: str | None = None, formats: list[str] | None = None, least: int = 10, question: str = "question", lang: str = "language") -> list[Rule]:
    """Rules of the unified item that its text, language and length decide."""
    q = F.coalesce(F.col(question), F.lit(""))
    out = [
        Rule("missing_question", trim_ws(q) == "", "error", question, "question is empty"),
        Rule("short_question", (trim_ws(q) != "") & (F.length(trim_ws(q)) < least), "warning", question, f"question is shorter than {least} characters"),
        Rule("missing_language", F.coalesce(F.col(lang), F.lit("")) == "", "error", lang, "language is empty"),
    ]
    if language:
        out.append(Rule("language_mismatch", F.coalesce(F.col(lang), F.lit("")) != language, "warning", lang, f"language is not {language}"))
    if formats:
        out.append(Rule("format_mismatch", ~F.col("format").isin(formats), "warning", "format", "format is not expected"))
    return out


def full_item_rules(modality: bool = True) -> list[Rule]:
    """Rules that need options, answers and images."""
    rules = [
        Rule("empty_answer", (F.coalesce(F.size("answer"), F.lit(0)) <= 0) | F.forall("answer", lambda x: trim_ws(x) == ""), "error", "answer", "answer is empty"),
        Rule("few_options", (F.col("format") == "MCQ") & (F.coalesce(F.size("options"), F.lit(0)) < 2), "error", "options", "fewer than two options"),
    ]
    if modality:
        rules.append(Rule("missing_image", (F.col("modality") == "Multimodal") & (F.coalesce(F.size("images"), F.lit(0)) <= 0), "error", "images", "multimodal without image"))
    return rules


def question_rules() -> list[Rule]:
    """Structural rules of a generated question."""
    q = lambda c: F.coalesce(trim_ws(F.col(c)), F.lit(""))
    mcq = F.col("question_type").isin("mcq_single", "mcq_multi")
    n_options = F.coalesce(F.size("options"), F.lit(0))
    n_set = F.coalesce(F.size("answer_set"), F.lit(0))
    return [
        Rule("missing_id", q("id") == ""),
        Rule("missing_stem", q("question_stem") == ""),
        Rule("short_explanation", F.length(q("answer_explanation")) < 10),
        Rule("bad_design", ~F.coalesce(F.col("design_type"), F.lit("")).isin("standard", "adversarial")),
        Rule("bad_difficulty", ~F.coalesce(F.col("difficulty"), F.lit("")).rlike("^L[1-5]$")),
        Rule("few_options", mcq & (n_options < 2)),
        Rule("options_present_non_mcq", ~mcq & (n_options > 0)),
        Rule("single_answer_is_list", (F.col("question_type") == "mcq_single") & (n_set > 0)),
        Rule("multi_answer_not_list", (F.col("question_type") == "mcq_multi") & (n_set <= 0)),
        Rule("missing_answer", (q("answer_text") == "") & (n_set <= 0)),
        Rule("time_out_of_range", F.col("estimated_time_sec").isNotNull() & ~F.col("estimated_time_sec").between(10, 600)),
        Rule("missing_subdomain", F.coalesce(F.col("subdomain"), F.lit("")) == ""),
    ]


def static_status(found: Column, fatal: list[str]) -> Column:
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, fatal))), "broken_static").otherwise("candidate")


def duplicate_stem(df: DataFrame, stem: str) -> DataFrame:
    """n_same: rows with the same normalised stem, by aggregation and join, so a frequent stem stays cheap."""
    norm = normalize_stem(F.col(stem))
    rows = df.withColumn("stem_norm", norm)
    return rows.join(rows.groupBy("stem_norm").agg(F.count(F.lit(1)).alias("n_same")), "stem_norm")


# Bounds of the vocabulary's form.
TERM_TOKENS, TERM_HAN = 4, 8


def token_length_ok(term: Column) -> Column:
    """1 to 4 words, or 1 to 8 Han characters."""
    return F.when(is_chinese(term), F.length(F.regexp_replace(term, f"[^{HAN[1:-1]}]", "")).between(1, TERM_HAN)).otherwise(F.size(F.filter(F.split(term, r"\s+"), lambda x: x != "")).between(1, TERM_TOKENS))


def term_reason(term: Column, df: Column, total: Column, stopwords: list[str], least: int = 2, share: float = 0.5) -> Column:
    """Why a term may not enter the vocabulary; null if it may."""
    return (
        F.when(F.length(term) < 3, "too_short")
        .when(~token_length_ok(term), "token_length")
        .when(term.isin(stopwords), "stopword")
        .when(df < least, "too_rare")
        .when(df > total * share, "too_common")
        .when(~term.rlike(r"^[\p{L}\p{N} +#./-]+$"), "charset")
        .when(term.rlike(r"^\d+$"), "numeric")
    )


# Endings of placeholder terms.
PLACEHOLDERS = ["subdomain", "topic", "category", "concept", "domain", "area"]


def form_reason(term: Column, df: Column, total: Column, stopwords: list[str], share: float = 0.40, language: str = "en") -> Column:
    """Why a term's form bars it from the vocabulary; null if it does not.  Chinese, or any Han character, has bounds of its own."""
    t = trim_ws(term)
    low = F.lower(t)
    tokens = F.split(low, r"\s+")
    common = df > total * share
    han = (
        F.when(F.length(t) < 2, "too_short")
        .when(F.length(t) > 12, "too_long")
        .when(~t.rlike(rf"^({HAN}|[\p{{Nd}}()\-（）/、·])+$"), "invalid_charset")
        .when(t.isin(stopwords), "stopword")
        .when(df < 2, "too_rare")
        .when(common, "too_common")
    )
    other = (
        F.when(F.length(low) < 3, "too_short")
        .when(F.forall(tokens, lambda x: x.isin(stopwords)), "all_stopwords")
        .when(df < 3, "too_rare")
        .when(common, "too_common")
        .when(~term.rlike(r"^[a-zA-Z0-9\s/()+*\-.]+$"), "invalid_charset")
        .when(F.element_at(tokens, -1).isin(PLACEHOLDERS), "placeholder_suffix")
    )
    return F.when(t == "", "empty").when(is_chinese(t) | F.lit(language == "zh"), han).otherwise(other)


def denied(term: Column, deny: list[str], exceptions: list[str]) -> Column:
    return ~term.isin(exceptions) & term.isin(deny)


def floors(metrics: dict[str, float]) -> Column:
    """Names of metrics below their floors, sorted."""
    return flags([Rule(name, F.col(name) < floor) for name, floor in metrics.items()])
