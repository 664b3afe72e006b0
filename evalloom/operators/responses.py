"""Model responses: the boundary to models, provider batch files, repair and backfill passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.arrays import is_empty_prediction, parse_multi, parse_single
from evalloom.functions.jsonx import complete_objects, judge_verdict, text_blocks
from evalloom.functions.mathx import soft_score
from evalloom.functions.text import truthy


class Oracle(Protocol):
    """Anything that answers a batch of prompts; deterministic in tests."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def ask(df: DataFrame, prompt: str, oracle: Callable[[list[str]], list[str | None]], alias: str = "raw_output", batch: int = 32) -> DataFrame:
    """``df`` with the oracle's answers; an answer that fails is null, with its error beside it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers: list[str | None] = []
            errors: list[str | None] = []
            prompts = pdf[prompt].tolist()
            for i in range(0, len(prompts), batch):
                part = prompts[i : i + batch]
                try:
                    answers += oracle(part)
                    errors += [None] * len(part)
                except Exception as e:  # one failed request must not fail the table
                    answers += [None] * len(part)
                    errors += [str(e)] * len(part)
            yield pdf.assign(**{alias: answers, "call_error": errors})

    return df.mapInPandas(run, f"{fields}, `{alias}` string, call_error string")


def fallback(*responses: Column) -> Column:
    """First response that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(r) != "", r) for r in responses))


def batch_text(df: DataFrame) -> DataFrame:
    """custom_id, raw of the succeeded lines of a provider's batch file."""
    return df.where("result.type = 'succeeded'").select("custom_id", text_blocks(F.col("result.message.content")).alias("raw"))


def batch_questions(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """custom_id, position, question (JSON) of every complete object, for batches that the plan knows."""
    known = lines.join(plan.select("custom_id").distinct(), "custom_id")
    return known.select("custom_id", F.posexplode(complete_objects("raw")).alias("position", "question"))


def parsed(df: DataFrame, raw: str = "raw_output", qtype: str = "question_type") -> DataFrame:
    multi = F.col(qtype) == "mcq_multi"
    return df.withColumn("parsed_set", F.when(multi, parse_multi(F.col(raw)))).withColumn("parsed_answer", F.when(F.col(qtype) == "mcq_single", parse_single(F.col(raw))).when(~multi, F.trim(raw)))


def needs_judge() -> Column:
    return (F.col("scoring_method") == "llm_judge") & F.col("judge_score").isNull()


def needs_rerun() -> Column:
    return F.col("call_error").isNotNull() | (F.coalesce(F.trim("raw_output"), F.lit("")) == "") | is_empty_prediction(F.col("parsed_answer"), F.col("parsed_set"))


def backfill(answers: DataFrame, verdicts: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """Judge scores joined to the rows that lack them; correctness and soft score follow."""
    got = verdicts.select(*keys, judge_verdict(F.col("raw"))["score"].alias("_score"))
    rows = answers.join(got, keys, "left")
    score = F.when(needs_judge(), F.col("_score")).otherwise(F.col("judge_score"))
    rows = rows.withColumn("judge_score", score).withColumn("is_correct", F.when(F.col("scoring_method") == "llm_judge", F.col("judge_score") >= threshold).otherwise(F.col("is_correct")))
    return rows.withColumn("soft_score", soft_score(F.col("judge_score"), F.col("is_correct"), F.col("scoring_method"))).drop("_score")


def is_core() -> Column:
    """Records that count: clean or only statically suspect, and scored."""
    return F.col("item_status").isin("clean", "suspect_static") & (F.coalesce(F.col("scoring_method"), F.lit("")) != "skip_core")


def core_vs_skip(df: DataFrame, key: Column) -> DataFrame:
    skip = F.coalesce(F.col("scoring_method") == "skip_core", F.lit(False))
    return df.groupBy(key.alias("key")).agg(F.count_if(~skip).alias("core"), F.count_if(skip).alias("skip"))


def clear_flag(flags: str, flag: str, status: str) -> tuple[Column, Column]:
    """Flags without one, and the status that follows."""
    left = F.array_remove(flags, flag)
    return left, F.when(F.size(left) == 0, "candidate").otherwise(F.col(status))


def hygiene(terms: Column, text: Column, glossary: Column, most: int = 12, fold_case: bool = False) -> Column:
    """Terms in order: kept if the text has them, else replaced by the first glossary entry not used yet, else dropped; capped.

    With ``fold_case`` terms that differ in case alone are one; the first spelling stays.
    """
    form = F.lower if fold_case else lambda c: c
    used = lambda acc, x: F.exists(acc, lambda y: form(y) == form(x))

    def step(acc: Column, term: Column) -> Column:
        here = F.contains(F.lower(text), F.lower(term))
        free = F.filter(glossary, lambda g: ~used(acc, g) & F.contains(F.lower(text), F.lower(g)))
        pick = F.when(here, term).otherwise(F.try_element_at(free, F.lit(1)))
        return F.when(pick.isNull() | used(acc, pick) | (F.size(acc) >= most), acc).otherwise(F.array_append(acc, pick))

    return F.aggregate(terms, F.array().cast("array<string>"), step)


# The most tokens and calls a repeated request gets, and what an error says that a larger budget cures.
MOST_TOKENS, MOST_CALLS, BUDGET_ERRORS = 8192, 3, ("max_tokens", "output limit")


def reanswer(df: DataFrame, prompt: str, budget: str, oracle: Callable[[list[str], list[int]], list[str | Exception | None]], most: int = MOST_TOKENS, calls: int = MOST_CALLS) -> DataFrame:
    """``df`` with raw_output, calls, max_tokens and call_error of a repeated request.

    The oracle gets prompts with their budgets; its answer to one may be an exception.  A blank answer or an error of the
    budget doubles the budget, up to ``most``; a blank answer at ``most`` and any other error end the row's calls.  An
    oracle that raises fails the requests it was given, not the table.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def attempt(prompts: list[str], tokens: list[int]) -> list[str | Exception | None]:
        try:
            return oracle(prompts, tokens)
        except Exception as e:
            return [e] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            prompts, tokens = pdf[prompt].tolist(), [int(x) for x in pdf[budget]]
            raw: list[str | None] = [None] * len(pdf)
            error: list[str | None] = [None] * len(pdf)
            used = [0] * len(pdf)
            pending = list(range(len(pdf)))
            for _ in range(calls):
                again = []
                for i, got in zip(pending, attempt([prompts[i] for i in pending], [tokens[i] for i in pending]) if pending else [], strict=True):
                    used[i] += 1
                    failed = isinstance(got, Exception)
                    raw[i], error[i] = (None, str(got)) if failed else (got, None)
                    if failed and not any(x in str(got) for x in BUDGET_ERRORS):
                        continue
                    if not failed and got and got.strip():
                        continue
                    larger = min(tokens[i] * 2, most)
                    if failed or larger > tokens[i]:
                        again.append(i)
                    tokens[i] = larger
                pending = again
            yield pdf.assign(raw_output=raw, calls=used, max_tokens=tokens, call_error=error)

    return df.mapInPandas(run, f"{fields}, raw_output string, calls int, max_tokens int, call_error string")


# The fields of a question that its answer's record repeats.
RECORD_FIELDS = ["super_parent", "subdomain", "question_type", "design_type", "declared_difficulty", "answer_type", "language", "visual_condition", "generation_index", "modality", "question_stem", "options", "item_status", "item_quality_flags", "item_quality_source"]
CALL_FIELDS = ["parsed_answer", "scoring_method", "correctness_source", "correctness_reason", "answer_time_ms", "call_batch_id", "call_batch_index", "call_batch_size", "call_index_in_batch", "call_error", "judge_score"]


def answer_record(df: DataFrame, dataset: str, designer: dict[str, str], answerer: dict) -> DataFrame:
    """The record of an answer, from a question and its call side by side; fields that ``df`` lacks are null.

    A failed call without a verdict counts as wrong.  ``designer`` has key and model, ``answerer`` key, name, temperature,
    top_p; ``max_new_tokens`` comes from the column ``max_tokens``.
    """
    have = set(df.columns)
    get = lambda name, kind="string": F.col(f"`{name}`") if name in have else F.lit(None).cast(kind)
    correct = get("is_correct", "boolean")
    verdict = F.when(get("call_error").isNotNull(), F.coalesce(correct, F.lit(False))).otherwise(correct)
    given = lambda *names: truthy(*(get(n).cast("string") for n in names))
    return df.select(
        F.coalesce(given("dataset", "source_dataset"), F.lit(dataset)).alias("dataset"),
        F.coalesce(given("designer_model"), F.lit(designer["model"])).alias("designer_model"),
        F.lit(designer["key"]).alias("designer_id"),
        F.lit(answerer["name"]).alias("answer_model"),
        F.lit(answerer["key"]).alias("answer_model_id"),
        given("question_id", "id").alias("question_id"),
        *(get(n).alias(n) for n in RECORD_FIELDS + CALL_FIELDS),
        F.coalesce(get("gold_answer"), get("answer")).alias("gold_answer"),
        get("raw_output").alias("model_output_raw"),
        verdict.alias("is_correct"),
        soft_score(get("judge_score", "double").cast("double"), verdict, get("scoring_method")).alias("soft_score"),
        F.struct(F.lit(answerer.get("temperature")).cast("double").alias("temperature"), F.lit(answerer.get("top_p")).cast("double").alias("top_p"), get("max_tokens", "int").alias("max_new_tokens")).alias("model_parameters"),
    )
