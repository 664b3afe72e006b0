"""Readers: JSON lines, JSON arrays, quarantine of bad rows, positions, file discovery."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a bad line is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(paths)


def json_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines or one top-level array, by the first character that is not white space."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    multi = bool(head) and head[0].value.lstrip().startswith("[")
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", multi)
    return (reader.schema(schema) if schema else reader).json(path)


def quarantined(spark: SparkSession, paths: str | list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file): a bad line is kept, not lost."""
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    raw = spark.read.text(paths).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = raw.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select(*(F.col(f"r.`{f.name}`") for f in schema.fields)), parsed.where(bad).select(F.col("value").alias("_corrupt_record"), "_file")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 1), value of every line of text files, blank ones included, however the files are split.

    Within a split lines come in order, so a line's number is its place in the split and the number of lines
    in the file's splits before; only a row a split is shuffled to learn that.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return raw.join(placed, ["file", "block"]).select("file", (F.col("seq") + F.col("shift")).alias("line"), "value")


def numbered(spark: SparkSession, paths: str | list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(file, line and columns of the good rows; file, line, _corrupt_record of the bad ones): blank lines count, but are no rows."""
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = lines(spark, paths).where(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select("file", "line", *(F.col(f"r.`{f.name}`") for f in schema.fields)), parsed.where(bad).select("file", "line", F.col("value").alias("_corrupt_record"))


def line_counts(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """file, lines, blank, bad, good of every file that has a line: what a scan of many files read and what it dropped."""
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), (F.trim("value") == "").alias("blank"), parsed.alias("r"))
    bad = ~F.col("blank") & (F.col("r._corrupt_record").isNotNull() | F.col("r").isNull())
    one = lambda c: F.count(F.when(c, 1))
    return raw.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), one(F.col("blank")).alias("blank"), one(bad).alias("bad"), one(~F.col("blank") & ~bad).alias("good"))


def files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder whose names match, sorted; listed by Hadoop, so any store does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if fnmatch.fnmatch(s.getPath().getName(), pattern))


def newest(spark: SparkSession, folders: list[str], pattern: str) -> str | None:
    """The last match by name in the first folder that has any."""
    return next((found[-1] for folder in folders if (found := files(spark, folder, pattern))), None)


def question_file(spark: SparkSession, folder: str) -> str | None:
    """The cleaned file if there is one, else the raw one."""
    return newest(spark, [folder], "*_stage3_clean.jsonl") or newest(spark, [folder], "questions_*.jsonl")


def answer_files(spark: SparkSession, folder: str, dataset: str, designer: str | None = None, answerer: str | None = None) -> list[str]:
    """Pair files of a dataset, chosen by the models in their names before anything is read."""
    return files(spark, folder, f"{dataset}_stage3_answers_{designer or '*'}_vs_{answerer or '*'}.jsonl")


def pair_models(df: DataFrame, name: str = "_file") -> DataFrame:
    """designer, answerer from ``..._stage3_answers_{designer}_vs_{answerer}.jsonl``."""
    pattern = r"_stage3_answers_(.+?)_vs_(.+?)\.jsonl$"
    return df.withColumn("designer", F.regexp_extract(name, pattern, 1)).withColumn("answerer", F.regexp_extract(name, pattern, 2))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def images(df: DataFrame, listing: DataFrame, path_col: str = "image", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows whose image exists: the first rule that fits rewrites the path's prefix, then a semi-join with the listing."""
    p = F.col(path_col)
    fixed = F.coalesce(*(F.when(p.startswith(a), F.concat(F.lit(b), F.substr(p, F.lit(len(a) + 1)))) for a, b in rules or []), p)
    return df.withColumn(path_col, fixed).join(listing.select(F.col("path").alias(path_col)), path_col, "left_semi")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def config(text: str) -> dict:
    """A config as JSON, or as YAML where that library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)
