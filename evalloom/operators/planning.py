"""Quota planning on the driver: as many steps as a config has quotas, never as many as the data has rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.mathx import largest_remainder, share_split
from evalloom.operators.lineage import cut


@dataclass(frozen=True)
class Quota:
    parent: str
    standard: int
    adversarial: int


@dataclass(frozen=True)
class Coverage:
    dataset: str
    quotas: list[Quota]
    difficulty: dict[str, float]
    formats: dict[str, float]

    @property
    def total(self) -> int:
        return sum(q.standard + q.adversarial for q in self.quotas)


# A coverage config.
CS_COVERAGE = Coverage(
    "csbench_en",
    [
        Quota("CS.Core.DataStructuresAlgorithms", 60, 20),
        Quota("CS.Core.OperatingSystem", 50, 15),
        Quota("CS.Core.ComputerNetwork", 40, 12),
        Quota("CS.Core.ComputerOrganization", 30, 10),
        Quota("CS.Systems.FileSystemAndIO", 20, 8),
        Quota("CS.Systems.ProcessesAndThreads", 15, 5),
        Quota("CS.Foundations.OverviewAndDefinitions", 10, 5),
    ],
    {"L1": 0.15, "L2": 0.25, "L3": 0.30, "L4": 0.20, "L5": 0.10},
    {"mcq_single": 0.60, "mcq_multi": 0.10, "open_ended": 0.20, "structured": 0.10},
)


@dataclass
class Batch:
    batch_id: str
    parent: str
    index: int
    standard: int
    adversarial: int
    difficulty: dict[str, int] = field(default_factory=dict)
    formats: dict[str, int] = field(default_factory=dict)


def plan(config: Coverage, size: int = 20) -> list[Batch]:
    """Batches of at most ``size`` questions for every quota, each with its own targets."""
    out = []
    for q in config.quotas:
        std, adv, index = q.standard, q.adversarial, 0
        while std + adv:
            index += 1
            n = min(size, std + adv)
            a, b = share_split(std, adv, n)
            std, adv = std - a, adv - b
            out.append(Batch(f"{config.dataset}_{q.parent}_{index:03d}", q.parent, index, a, b, largest_remainder(config.difficulty, n), largest_remainder(config.formats, n)))
    return out


def plans(spark: SparkSession, config: Coverage, size: int = 20) -> DataFrame:
    rows = [(b.batch_id, b.parent, b.index, b.standard, b.adversarial, b.difficulty, b.formats) for b in plan(config, size)]
    return spark.createDataFrame(rows, "batch_id string, parent string, idx int, standard int, adversarial int, difficulty map<string,int>, formats map<string,int>")


def quota_batches(quotas: DataFrame, prefix: str, size: int = 20) -> DataFrame:
    """batch_id, parent, idx, standard, adversarial: the batches of every quota (parent, standard, adversarial).

    Parents are spread over tasks; a parent's batches follow each other, as each takes its share of what is left.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for parent, std, adv in zip(pdf.parent, pdf.standard, pdf.adversarial, strict=True):
                index = 0
                while std + adv > 0:
                    index += 1
                    a, b = share_split(std, adv, min(size, std + adv))
                    std, adv = std - a, adv - b
                    out.append((f"{prefix}_{parent}_{index:03d}", parent, index, a, b))
            yield pd.DataFrame(out, columns=["batch_id", "parent", "idx", "standard", "adversarial"])

    return quotas.select("parent", "standard", "adversarial").mapInPandas(run, "batch_id string, parent string, idx long, standard long, adversarial long")


def deficits(quotas: DataFrame, actual: DataFrame, keys: list[str], target: str = "quota") -> DataFrame:
    """What each bucket lacks, and whether any bucket lacks something."""
    got = quotas.join(actual, keys, "left").fillna(0, ["actual"])
    return got.withColumn("deficit", F.greatest(F.lit(0), F.col(target) - F.col("actual")).cast("long"))


def topup_requests(lacking: DataFrame) -> DataFrame:
    """Requests in order: adversarial first, larger first, then by name."""
    return lacking.where("deficit > 0").orderBy(F.when(F.col("design_type") == "adversarial", 0).otherwise(1), F.desc("deficit"), "super_parent")


def take_from(deficit: dict[str, int], want: int) -> dict[str, int]:
    """Draw ``want`` units from shared deficits in key order; the deficits shrink."""
    out = {}
    for key in deficit:
        n = min(want, deficit[key])
        if n:
            out[key], deficit[key], want = n, deficit[key] - n, want - n
    return out


def topup_plan(requests: list[tuple[str, str, int]], difficulty: dict[str, int], formats: dict[str, int], size: int = 20) -> list[Batch]:
    """Batches for requests (parent, design, count); difficulty and format deficits are shared across parents."""
    out, counter = [], {}
    for parent, design, count in requests:
        while count > 0:
            n = min(size, count)
            counter[parent] = counter.get(parent, 0) + 1
            out.append(Batch(f"topup_{parent}_{counter[parent]:03d}", parent, counter[parent], n * (design == "standard"), n * (design != "standard"), take_from(difficulty, n), take_from(formats, n)))
            count -= n
    return out


def avoid(stems: list[str], most: int = 20) -> str:
    """Instruction that lists stems not to repeat."""
    return "" if not stems else "Do not repeat these questions:\n" + "\n".join(f"- {s[:120]}" for s in stems[:most])


def coverage_table(config: Coverage) -> str:
    lines = [f"{'parent':44}{'standard':>10}{'adversarial':>13}"]
    return "\n".join(lines + [f"{q.parent:44}{q.standard:>10}{q.adversarial:>13}" for q in config.quotas] + [f"{'total':44}{sum(q.standard for q in config.quotas):>10}{sum(q.adversarial for q in config.quotas):>13}"])


def generate(first: DataFrame, lacking, ask, rounds: int = 3) -> DataFrame:
    """Bounded top-up: while something is lacking, ``ask`` for it and append; each round is stored, so lineage stays short.

    ``lacking(df)`` is a DataFrame of requests, ``ask(requests)`` of new rows.
    """
    have = first
    for _ in range(rounds):
        need = lacking(have)
        if not need.limit(1).count():
            break
        have = cut(have.unionByName(ask(need), allowMissingColumns=True))
    return have


def deviation(actual: Column, expected: Column, most: float) -> Column:
    return F.abs(actual - expected) > most
