"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``.  All but the last return the columns of ``documents``; further columns are
carried along, whatever their names.

Stages decide row by row: a row is known by its identifier and its text, so rows that share an identifier
with different texts stand apart, and so do rows without one.  Of rows equal in both, ``near_duplicates``
keeps one if their text has words.  Null and empty texts, and texts without a letter, leave with
``language_id``; a later stage that is handed some keeps them, but for ``repeated_passages``, which drops what has
no text left.  Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import op1_ngram_join, op4_packing, op5_suffix_dedup, op7_language, op8_decontam
from evalloom.llm.common import column, discard, materialise, private, scratch, table, text_key


def _known(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with doc_id, text_key of ``rows``; null identifiers match, and no column clashes."""
    ident, key = private(docs, "ident", "key")
    named = rows.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(named, same, how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letter, or a narrow margin) go."""
    model = op7_language.fit(docs.where(~op7_language.held_out() & F.col("doc_id").isNotNull()))
    names = private(docs, "lang_pred", "score", "rejected")
    judged = op7_language.predict(docs, model, keep=docs.columns, names=names)
    return judged.where(~F.col(names[2])).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the first row stays; documents without words are in none."""
    rows = op1_ngram_join.link(docs, k=5, num=80, den=100)
    kept = _known(docs, rows.where(~F.col("leads")), "left_anti")
    again = materialise(rows.where(F.col("leads") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    if not again.limit(1).count():
        return kept
    (key,) = private(docs, "key")
    one = _known(kept, again, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return _known(kept, again, "left_anti").unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier document has are cut; documents of which nothing but space is left go, null texts too."""
    cut = op5_suffix_dedup.deduplicate(docs)
    size = F.length("text").cast("long")
    return cut.where(F.trim("text") != "").select(*(size.alias(c) if c == "n_chars" else column(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    return _known(docs, op8_decontam.find(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return op4_packing.digests(op4_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Compression sizes and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves behind is deleted as soon as the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as keep:
            docs = materialise(stage(spark, before, sf_dir), name)
            keep.append(docs)
        if name != STAGES[0][0]:
            discard(spark, before)
    return docs
