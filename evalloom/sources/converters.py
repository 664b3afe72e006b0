"""Converters: raw benchmark rows to the unified item; projections of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import language_name, nz, options_of_string, strip_numbering, trim_ws, truthy

ITEM = (
    "id string, question string, options array<struct<letter:string,content:string>>, answer array<string>, language string, format string, modality string, "
    "context struct<story:string>, background map<string,string>, images array<string>"
)


def column(df: DataFrame, *names: str) -> Column:
    """First value under any of the names that is neither null nor empty; names that the frame lacks are skipped."""
    have = {c.lower(): c for c in df.columns}
    found = dict.fromkeys(have[n.lower()] for n in names if n.lower() in have)
    return truthy(*(F.col(f"`{c}`").cast("string") for c in found)) if found else F.lit(None).cast("string")


def finalize(df: DataFrame) -> DataFrame:
    """Exactly the unified item's columns, with its defaults."""
    empty = {"options": "array<struct<letter:string,content:string>>", "answer": "array<string>", "images": "array<string>", "background": "map<string,string>", "context": "struct<story:string>"}
    out = []
    for name, default in (("id", None), ("question", ""), ("options", ()), ("answer", ()), ("language", "en"), ("format", "MCQ"), ("modality", "Text"), ("context", None), ("background", {}), ("images", ())):
        have = F.col(name) if name in df.columns else F.lit(None).cast(empty.get(name, "string"))
        if name == "id":
            out.append(have.cast("string").alias(name))
        elif name == "context":
            out.append(have.alias(name))
        elif name == "background":
            out.append(F.coalesce(have, F.create_map().cast("map<string,string>")).alias(name))
        elif name in empty:
            out.append(F.coalesce(have, F.array().cast(empty[name])).alias(name))
        else:
            out.append(F.coalesce(have, F.lit(default)).alias(name))
    return df.select(*out)


def _lettered(contents: list[Column]) -> Column:
    made = F.array(*(F.struct(F.lit("ABCDEFGH"[i]).alias("letter"), c.alias("content")) for i, c in enumerate(contents)))
    return F.filter(made, lambda x: nz(x["content"]).isNotNull())


def letters(answer: Column) -> Column:
    """An answer as a list of letters; null is the empty list."""
    return F.when(nz(trim_ws(answer)).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.filter(F.split(answer, r"[,;\s]+"), lambda x: x != ""), lambda x: F.trim(x)))


def cs(df: DataFrame) -> DataFrame:
    """Rows with columns A to D."""
    bg = F.map_filter(F.create_map(*(x for k in ("Domain", "SubDomain", "Tag") for x in (F.lit(k.lower()), column(df, k)))), lambda _, v: v.isNotNull())
    return finalize(
        df.select(
            column(df, "ID").alias("id"), strip_numbering(column(df, "Question")).alias("question"), _lettered([column(df, c) for c in "ABCD"]).alias("options"),
            letters(column(df, "Answer")).alias("answer"), language_name(column(df, "Language")).alias("language"), column(df, "Format").alias("format"), bg.alias("background"),
        )
    )


def medical(df: DataFrame) -> DataFrame:
    """Rows with a map of options; images decide the modality."""
    entries = F.array_sort(F.transform(F.map_entries("options"), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("content"))))
    pictures = F.transform("images", lambda x: x["image_path"])
    has = F.coalesce(F.size(pictures), F.lit(0)) > 0
    bg = F.map_filter(F.create_map(*(x for k in ("question_type", "medical_task", "body_system") for x in (F.lit(k), column(df, k)))), lambda _, v: v.isNotNull())
    question = trim_ws(F.split("question", r"(?i)\n\s*answer\s*choices\s*:?")[0])
    return finalize(df.select(F.col("id"), question.alias("question"), entries.alias("options"), letters(F.col("label")).alias("answer"), F.lit("English").alias("language"), F.when(has, "Multimodal").otherwise("Text").alias("modality"), pictures.alias("images"), bg.alias("background")))


def math(df: DataFrame) -> DataFrame:
    """Rows whose options are one string."""
    bg = F.map_filter(F.create_map(F.lit("concept"), column(df, "knowledge concept"), F.lit("description"), column(df, "knowledge concept description")), lambda _, v: v.isNotNull())
    image = nz(column(df, "image_path"))
    return finalize(df.select(column(df, "ID").alias("id"), strip_numbering(column(df, "question")).alias("question"), options_of_string(column(df, "option")).alias("options"), letters(column(df, "answer")).alias("answer"), F.lit("English").alias("language"), F.when(image.isNotNull(), "Multimodal").otherwise("Text").alias("modality"), F.filter(F.array(image), lambda x: x.isNotNull()).alias("images"), bg.alias("background")))


def bilingual(df: DataFrame, pairs: dict[str, dict[str, str]]) -> DataFrame:
    """Wide rows to one row a language: ``pairs`` names each language's columns (story, question, options A to D, answer)."""
    def side(lang: str, c: dict[str, str]) -> Column:
        opt = lambda k: F.when(F.lower(F.col(f"`{c[k]}`").cast("string")) != "nan", F.col(f"`{c[k]}`").cast("string"))
        return F.struct(F.lit(lang).alias("language"), F.col(f"`{c['story']}`").alias("story"), F.col(f"`{c['question']}`").alias("question"), _lettered([opt(k) for k in "ABCD"]).alias("options"), letters(F.col(f"`{c['answer']}`")).alias("answer"))

    rows = df.select("id", F.explode(F.array(*(side(lang, c) for lang, c in pairs.items()))).alias("x"))
    return finalize(rows.select("id", "x.question", "x.options", "x.answer", "x.language", F.struct(F.col("x.story").alias("story")).alias("context")))


def item_text(options: str = "options") -> Column:
    """Labelled rendering of an item."""
    opts = F.array_join(F.transform(options, lambda o: F.concat_ws(". ", o["letter"], o["content"])), "\n")
    bg = F.array_join(F.transform(F.map_entries("background"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    label = lambda name, c: F.concat(F.lit(name + ": "), nz(c))
    return F.concat_ws("\n", label("Story", F.col("context.story")), label("Question", F.col("question")), label("Options", opts), label("Background", bg))


def item_text_short() -> Column:
    """Question, then background values of more than 10 characters, then context."""
    return F.concat_ws(" ", nz(F.col("question")), F.array_join(F.filter(F.map_values("background"), lambda v: F.length(v) > 10), " "), nz(F.col("context.story")))


def summary(*cols: Column, most: int = 200) -> Column:
    return F.left(F.regexp_replace(truthy(*cols), r"\s*\n\s*", " "), F.lit(most))


def without_images(df: DataFrame, *cols: str) -> DataFrame:
    """Text-only rows lose their image fields."""
    return df.select(*(F.when(F.col("modality") == "Text", F.lit(None).cast(t)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c, t in df.dtypes))


def all_images(*arrays: Column) -> Column:
    """Ordered distinct images of several places."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def question_record(df: DataFrame, position: str) -> DataFrame:
    """Question with identifiers, gold answer, inferred types and defaults."""
    numeric = F.col("answer_text").rlike(r"^[\s\d\.,eE+\-*/^()]+$")
    kind = F.coalesce(nz(F.col("answer_type")) if "answer_type" in df.columns else F.lit(None).cast("string"), F.when(numeric, "numeric").when(F.col("question_type") == "mcq_multi", "multi").when(F.col("question_type") == "mcq_single", "single").when(F.col("question_type") == "structured", "structured").otherwise("open"))
    modality = F.lower(F.coalesce("modality", F.lit("")))
    visual = F.when(modality.contains("required"), "visual_required").when(modality.contains("image") | modality.contains("multimodal"), "visual_optional").otherwise("text_only")
    return df.withColumns({
        "question_id": F.coalesce(nz(F.col("id").cast("string")), F.format_string("q_%04d", F.col(position))),
        "gold_answer": F.coalesce(nz(F.col("answer_text")), F.array_join("answer_set", ",")),
        "answer_type": kind,
        "visual_condition": visual,
        "generation_index": F.col(position),
        "item_status": F.lit("candidate"),
    })


def question_defaults(df: DataFrame, designer: str, dataset: str) -> DataFrame:
    """Generated questions with their defaults; free-form ones have no options."""
    none = F.array().cast("array<string>")
    design = F.lower(F.trim(F.coalesce(nz(F.col("design_type")), F.lit("standard"))))
    kind = F.coalesce("question_type", F.when(F.coalesce(F.size("options"), F.lit(0)) > 0, "mcq_single").otherwise("open_ended"))
    rows = df.withColumns({
        "designer_model": F.coalesce("designer_model", F.lit(designer)),
        "source_dataset": F.lit(dataset),
        "design_type": F.when(design.isin("standard", "adversarial"), design).otherwise("standard"),
        "question_type": kind,
        "uses_visual": F.coalesce("uses_visual", F.lit(False)),
    })
    return rows.withColumn("options", F.when(F.col("question_type").isin("open_ended", "structured"), none).otherwise(F.coalesce("options", none)))


def quality_fields(df: DataFrame) -> DataFrame:
    """Status, flags and sources of a record; the static rules are always a source."""
    none = F.array().cast("array<string>")
    return df.withColumns({
        "item_status": F.coalesce("item_status", F.lit("candidate")),
        "item_quality_flags": F.coalesce("item_quality_flags", none),
        "item_quality_source": F.array_union(F.coalesce("item_quality_source", none), F.array(F.lit("static_rules"))),
    })


def style(language: Column, kind: Column, modality: Column) -> Column:
    """struct(language, format, modality) with defaults."""
    return F.struct(language_name(F.coalesce(language, F.lit("en"))).alias("language"), F.coalesce(kind, F.lit("Multiple-choice")).alias("format"), F.coalesce(modality, F.lit("Text")).alias("modality"))


def prompt(stem: Column, options: Column, qtype: Column) -> Column:
    """Prompt text of a question, options by letter of their place."""
    letters_ = F.array(*(F.lit(c) for c in "ABCDEFGH"))
    body = F.array_join(F.transform(options, lambda x, i: F.concat_ws(". ", F.element_at(letters_, i + 1), x)), "\n")
    ask = F.when(qtype == "mcq_single", "Answer with one letter.").when(qtype == "mcq_multi", "Answer with a JSON array of letters.").otherwise("Answer briefly.")
    return F.concat_ws("\n", stem, nz(body), ask)
