"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """ANSI semantics, adaptive execution and UTC; ``conf`` adds to or overrides the settings."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName("evalloom").config(map=settings).getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster ship it with ``--py-files``."""
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
    return spark
