"""Domain card, sunburst nodes, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup(records: DataFrame, parent: str, label: str, terms: str, id_col: str, n_terms: int = 15, n_samples: int = 2) -> DataFrame:
    """Per parent: records, its labels with counts, its most frequent terms, and its first samples."""
    base = records.groupBy(parent).agg(F.countDistinct(id_col).alias("records"))
    labels = records.groupBy(parent, label).agg(F.countDistinct(id_col).alias("n")).groupBy(parent).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(label).alias("label")))).alias("l"))
    words = records.select(parent, id_col, F.explode(terms).alias("t")).groupBy(parent, "t").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("n"), "t"))
    top = words.withColumn("r", rank).where(F.col("r") <= n_terms).groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("typical_terms"))
    first = F.row_number().over(Window.partitionBy(parent).orderBy(id_col))
    samples = records.select(parent, id_col).distinct().withColumn("r", first).where(F.col("r") <= n_samples).groupBy(parent).agg(F.array_sort(F.collect_list(id_col)).alias("samples"))
    return base.join(labels, parent, "left").join(top, parent, "left").join(samples, parent, "left").withColumn("labels", F.transform("l", lambda x: F.struct(x["label"].alias("label"), (-x["k"]).alias("count")))).drop("l")


def sunburst(df: DataFrame, parent: str, label: str) -> DataFrame:
    """id, up, value: one root, its parents, their labels; from one ROLLUP."""
    r = df.rollup(parent, label).agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("g"))
    node = F.when(F.col("g") == 3, "root").when(F.col("g") == 1, F.col(parent)).otherwise(F.concat_ws("/", parent, label))
    up = F.when(F.col("g") == 3, "").when(F.col("g") == 1, "root").otherwise(F.col(parent))
    return r.select(node.alias("id"), up.alias("up"), "value")


def context(ontology: DataFrame, glossary: DataFrame, samples: DataFrame, key: str = "super_parent") -> DataFrame:
    """Ontology, glossary and samples of a card by parent, whichever of them there are."""
    full = ontology.join(glossary, key, "full").join(samples, key, "full")
    return full.select(key, "labels", F.slice("typical_terms", 1, 15).alias("typical_terms"), F.slice("examples", 1, 2).alias("examples"))


def card(rolled: DataFrame, parent: str, meta: dict) -> dict:
    """The nested document; a card has a row a parent, a number that the taxonomy bounds."""
    rows = rolled.orderBy(F.desc("records"), parent).collect()
    return {
        "meta": meta,
        "ontology": [{"super_parent": r[parent], "count": r["records"], "mid_level_parents": [x.asDict() for x in r["labels"] or []]} for r in rows],
        "glossary": [{"super_parent": r[parent], "typical_terms": list(r["typical_terms"] or [])} for r in rows],
        "samples": [{"super_parent": r[parent], "examples": list(r["samples"] or [])} for r in rows],
    }


def to_yaml(doc, indent: int = 0) -> str:
    """Plain YAML of nested dicts and lists; scalars as JSON, which YAML includes."""
    pad = "  " * indent
    if isinstance(doc, dict):
        return "".join(f"{pad}{k}:\n{to_yaml(v, indent + 1)}" if isinstance(v, dict | list) and v else f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in doc.items())
    return "".join(f"{pad}-\n{to_yaml(v, indent + 1)}" if isinstance(v, dict | list) and v else f"{pad}- {json.dumps(v, ensure_ascii=False)}\n" for v in doc)


def report(title: str, metrics: dict[str, float], floors: dict[str, float]) -> str:
    """Text report with PASS or FAIL for every floor."""
    lines = [title, "=" * len(title)]
    for name, value in metrics.items():
        verdict = "" if name not in floors else "  PASS" if value is not None and value >= floors[name] else "  FAIL"
        lines.append(f"{name:32}{'n/a' if value is None else format(value, '.4f'):>12}{verdict}")
    return "\n".join(lines)


def quality_label(errors: int, warnings: int) -> str:
    """Four bands of 2 * errors + warnings."""
    points = 2 * errors + warnings
    return "excellent" if points == 0 else "good" if points <= 3 else "fair" if points <= 8 else "poor"
