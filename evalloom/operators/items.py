"""Operators on items and their extraction records: profile of a split, taggers, labels of a sibling set, hygiene, previews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.functions.text import nz, slugify

VISUAL = ["multimodal", "visual", "mixed"]


def characteristics(df: DataFrame, split: str, expected: DataFrame | None = None, subdomain: str | None = None, images: Column | None = None) -> DataFrame:
    """A row a split of items (language, format, modality): size and whether it is the expected one, the commonest language and
    format with the language's share, the share of multimodal items, the number of labels, whether any item has images.

    Absent languages and formats are ``Unknown``, an absent modality ``Text``.  Of equally common values the
    first by name is named.  Values are counted before they are compared, so a split is never in one task.
    """
    named = df.select(
        F.col(split).alias("split"), F.coalesce("language", F.lit("Unknown")).alias("language"), F.coalesce("format", F.lit("Unknown")).alias("format"), F.coalesce("modality", F.lit("Text")).alias("modality"),
        (nz(F.col(subdomain).cast("string")) if subdomain else F.lit(None).cast("string")).alias("subdomain"), F.coalesce(images, F.lit(False)).alias("image") if images is not None else F.lit(False).alias("image"),
    )
    counts = named.groupBy("split", "language", "format", "modality", "subdomain").agg(F.count(F.lit(1)).alias("n"), F.bool_or("image").alias("image"))

    def common(c: str) -> DataFrame:
        by = counts.groupBy("split", c).agg(F.sum("n").alias("n"))
        return by.groupBy("split").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v"))).alias(c))

    total = counts.groupBy("split").agg(
        F.sum("n").alias("total_size"), F.sum(F.when(F.lower("modality").isin(VISUAL), F.col("n")).otherwise(0)).alias("_visual"), F.count_distinct("subdomain").alias("subdomain_count"), F.bool_or("image").alias("has_images")
    )
    sized = total.join(expected.select(F.col(split).alias("split"), F.col("expected_size")), "split", "left") if expected is not None else total.withColumn("expected_size", F.lit(None).cast("long"))
    got = sized.join(common("language"), "split").join(common("format"), "split")
    return got.select(
        "split", "total_size", "expected_size", F.coalesce(F.col("total_size") == F.col("expected_size"), F.lit(True)).alias("size_match"), F.col("language.v").alias("primary_language"),
        F.round(-F.col("language.n") / F.col("total_size"), 6).alias("language_purity"), F.col("format.v").alias("primary_format"), F.round(F.col("_visual") / F.col("total_size"), 6).alias("multimodal_ratio"), "subdomain_count", "has_images",
    )


def tag(record: Column, tags: Column) -> Column:
    """An extraction with its labels replaced by canonical ones: the first labels stay as ``subdomains_native``; without tags nothing else changes."""
    native = F.coalesce(record["subdomains_native"], record["subdomains"])
    found = F.size(tags) > 0
    kept = record.withField("subdomains_native", native)
    return kept.withField("subdomains", F.when(found, tags).otherwise(record["subdomains"])).withField("subdomains_canonical", F.when(found, tags))


def sibling_labels(items: DataFrame, sibling: DataFrame, mapping: DataFrame, id_col: str = "id", labels: str = "labels") -> DataFrame:
    """id, labels of the item with the same identifier in a sibling set, each label mapped to this set's
    (``label``, ``canonical``), in order and without repeats; empty where the sibling has none.  Identifiers are compared as trimmed text."""
    key = lambda c: F.trim(F.col(c).cast("string"))
    other = sibling.select(key(id_col).alias("_k"), F.posexplode(labels).alias("pos", "label")).where("_k <> ''").join(mapping, "label").select("_k", "pos", "canonical")
    listed = other.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("m")).select("_k", F.array_distinct(F.transform("m", lambda x: x.canonical)).alias("_l"))
    joined = items.select(F.col(id_col).alias("id"), key(id_col).alias("_i")).join(listed, F.col("_i") == F.col("_k"), "left")
    return joined.select("id", F.coalesce("_l", F.array().cast("array<string>")).alias("labels"))


def preview(df: DataFrame, texts: str, images: str) -> DataFrame:
    """The first 3 texts and the first 2 images of each item."""
    return df.withColumns({texts: F.slice(texts, 1, 3), images: F.slice(images, 1, 2)})


def model_id(identifier: Column, name: Column) -> Column:
    """What rows are grouped by: the identifier, else the slug of the name; null if there is neither."""
    return F.coalesce(nz(identifier), nz(slugify(F.coalesce(name, F.lit("")))))


def count_by_parent(df: DataFrame, parent: str = "super_parent", design: str = "design_type") -> DataFrame:
    """super_parent, standard, adversarial; questions without a parent count as ``unknown``, designs other than adversarial as standard."""
    hard = F.lower(F.coalesce(design, F.lit(""))) == "adversarial"
    return df.groupBy(F.coalesce(nz(F.col(parent)), F.lit("unknown")).alias("super_parent")).agg(F.count(F.when(~hard, 1)).alias("standard"), F.count(F.when(hard, 1)).alias("adversarial"))


def as_list(value: Column) -> Column:
    """A variant as a list of variants: an array's elements, any other value alone, nothing for null."""
    one = F.array(value)
    return F.when(value.isNull() | F.is_variant_null(value), F.slice(one, 1, 0)).otherwise(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), one))


def objects(value: Column) -> Column:
    """The objects of a variant that is a list; other elements, and values that are no list, give nothing."""
    items = F.try_variant_get(value, "$", "array<variant>")
    only = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.coalesce(only, F.slice(F.array(value), 1, 0))


MOST_TERMS, MOST_SUBDOMAINS, MOST_CONTEXT = 12, 3, 5


def clean_extraction(terms: list[str], subdomains: list[str], text: str, glossary: list[str], good: Callable[[str], bool], short: Callable[[str], bool], category: Callable[[str], str]) -> tuple[list[str], list[str]]:
    """Terms and labels of one extraction after hygiene.

    A term stays if it is well formed, short enough, new and stands in the text; in place of one that goes, the next glossary entry
    that is well formed and stands in the text is tried.  Context terms beyond the fifth go, from the last on, while more than two terms are left.
    """
    low, kept, seen, used = text.lower(), [], set(), set()

    def accept(term: str) -> bool:
        key = term.lower()
        if not term or not short(term) or not good(term) or key in seen or key not in low or len(kept) >= MOST_TERMS:
            return False
        kept.append(term)
        seen.add(key)
        return True

    def spare() -> str | None:
        for entry in (g.strip() for g in glossary):
            if entry and entry.lower() not in used and good(entry) and entry.lower() in low:
                used.add(entry.lower())
                return entry
        return None

    for term in (t.strip() for t in terms):
        if len(kept) >= MOST_TERMS:
            break
        if not accept(term) and (other := spare()):
            accept(other)
    context = [i for i, t in enumerate(kept) if category(t) == "context"]
    for i in reversed(context[MOST_CONTEXT:]):
        if len(kept) > 2:
            kept.pop(i)
    labels, known = [], set()
    for label in (s.strip() for s in subdomains):
        if len(labels) < MOST_SUBDOMAINS and label and good(label) and label.lower() not in known:
            labels.append(label)
            known.add(label.lower())
    return kept, labels


def hygiene_pass(df: DataFrame, good: Callable[[str], bool], short: Callable[[str], bool], category: Callable[[str], str]) -> DataFrame:
    """``df`` (terms, subdomains, text, glossary, confidence, is_valid) with cleaned terms and subdomains, anchored_count,
    anchored_fraction and confidence 0 where no term is left; rows that are not valid stay as they are.

    Each row folds over its own few terms, over Arrow batches; nothing is shuffled.
    """
    schema = StructType([*df.schema.fields]).add("anchored_count", "long").add("anchored_fraction", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: [] if x is None else [t for t in x if t is not None]
        for pdf in frames:
            rows = [clean_extraction(some(t), some(s), x or "", some(g), good, short, category) if ok else (t, s) for t, s, x, g, ok in zip(pdf.terms, pdf.subdomains, pdf.text, pdf.glossary, pdf.is_valid, strict=True)]
            n = [len(some(t)) if ok else None for (t, _), ok in zip(rows, pdf.is_valid, strict=True)]
            pdf = pdf.assign(terms=[t for t, _ in rows], subdomains=[s for _, s in rows])
            pdf["confidence"] = [0.0 if k == 0 else c for k, c in zip(n, pdf.confidence, strict=True)]
            pdf["anchored_count"] = pd.array(n, "Int64")
            pdf["anchored_fraction"] = [None if k is None else 1.0 if k else 0.0 for k in n]
            yield pdf

    return df.mapInPandas(run, schema)
