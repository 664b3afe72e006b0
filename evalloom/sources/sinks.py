"""Sinks.  Nothing is rewritten in place: a new version is written beside the old one, then named current."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, join: str = "; ") -> None:
    """With a header; arrays of strings are joined."""
    cols = [F.concat_ws(join, c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def human_eval(df: DataFrame, path: str, blanks: tuple[str, ...] = ("rating_subdomains", "rating_terms", "rating_overall", "notes")) -> None:
    """CSV for annotators, with empty columns for their verdicts."""
    csv(df.select("*", *(F.lit("").alias(b) for b in blanks)), path)


def document(spark: SparkSession, doc: dict | str, path: str) -> None:
    """One small text document through Hadoop, so any store does."""
    text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def version(df: DataFrame, root: str, stamp: str | None = None) -> str:
    """Write a version folder and name it in ``CURRENT``; readers never see half a table."""
    where = f"{root.rstrip('/')}/v-{stamp or time.strftime('%Y%m%dT%H%M%S')}"
    df.write.mode("errorifexists").parquet(where)
    document(df.sparkSession, where, f"{root.rstrip('/')}/CURRENT")
    return where


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{root.rstrip('/')}/CURRENT").first().value)


def one(df: DataFrame) -> dict:
    """A one-row summary as a dict."""
    return json.loads(df.toJSON().first())


def sample(df: DataFrame, path: str, meta: dict) -> None:
    """Rows, with their metadata beside them."""
    jsonl(df, path)
    document(df.sparkSession, meta, path.rstrip("/") + ".meta.json")


def run(results: DataFrame, manifest: DataFrame, report: dict, root: str, stamp: str | None = None) -> str:
    """A run's results as JSON lines in a folder of its own, with the manifest's one row and the report beside them."""
    where = f"{root.rstrip('/')}/run-{stamp or time.strftime('%Y%m%dT%H%M%S')}"
    jsonl(results, f"{where}/results")
    document(results.sparkSession, report | {"manifest": one(manifest)}, f"{where}/report.json")
    return where
