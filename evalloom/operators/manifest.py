"""What a run was made of and what it did: content digests, run manifests, audits of removed rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def row_digest(columns: list[str]) -> Column:
    """SHA-256 over the cells as text, each with its length; null differs from every text."""
    cell = lambda c: F.when(F.col(c).isNull(), "N").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.sha2(F.concat(*(cell(c) for c in columns)), 256)


def multiset_digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """rows, digest: the same for the same rows in any order and partitioning, another if a byte or a count changes.

    The eight 32-bit words of the rows' digests are summed, so partitions and tables can be merged by adding.
    """
    h = df.select(*(by or []), row_digest(columns or sorted(df.columns)).alias("h"))
    word = lambda k: F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    sums = h.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"w{k}") for k in range(LANES)))
    return sums.select(*(by or []), "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *(f"w{k}" for k in range(LANES))), 256).alias("digest"))


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def run_manifest(df: DataFrame, dataset: str, prompt: str = "", parents: dict[str, str] | None = None, columns: list[str] | None = None, **settings: object) -> DataFrame:
    """One row: what was read (rows and digest), and with what (hashes of prompt, parent map and settings)."""
    named = {"dataset": dataset, "prompt_hash": text_hash(prompt), "parent_map_hash": text_hash(json.dumps(parents or {}, sort_keys=True)), "settings": json.dumps(settings, sort_keys=True)}
    return multiset_digest(df, columns).select(*(F.lit(v).alias(k) for k, v in named.items()), "rows", F.left("digest", F.lit(16)).alias("dataset_hash"))


def removal_audit(before: DataFrame, after: DataFrame, key: str, reason: Column) -> DataFrame:
    """reason, removed, first_key, last_key of the rows of ``before`` whose key is not in ``after``, and a row of totals (reason null).

    ``reason`` is an expression over ``before``.
    """
    gone = before.withColumn("_reason", F.coalesce(reason, F.lit("other"))).join(after.select(key).distinct(), key, "left_anti")
    return gone.rollup("_reason").agg(F.count(F.lit(1)).alias("removed"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).withColumnRenamed("_reason", "reason")
