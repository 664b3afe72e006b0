"""Agreement of two runs and quality of one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.arrays import consensus, jaccard_full
from evalloom.operators.similarity import soft_jaccard
from evalloom.operators.windows import running_id


def runs(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """id, a, b: first and second half of a row's distinct tokens, as two runs over the same item."""
    half = F.ceil(F.size(tokens) / 2).cast("int")
    return df.select(F.col(id_col).alias("id"), F.array_sort(F.slice(tokens, F.lit(1), F.greatest(half, F.lit(0)))).alias("a"), F.array_sort(F.slice(tokens, half + 1, F.size(tokens))).alias("b"))


def agreement(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(jaccard_full(F.col("a"), F.col("b")), 6).alias("jaccard"))


def nsi(df: DataFrame, shifts: int = 100, seed: int = 42, block: int = 4096) -> DataFrame:
    """items, jaccard_observed, jaccard_random, nsi of aligned runs (id, a, b): (observed - random) / (1 - random) within 0 and 1.

    The items stand in a circle in order of a seeded hash, so neighbours there have nothing to do with each other; the
    baseline compares run A of each item with run B of the ``shifts`` items after it (all others, if fewer).  Places
    come from the counts of range partitions.  A block of the circle needs its own rows and ``shifts`` rows of the next,
    so run B is sent little more than once, and the work grows with the items.  No items, one item, or a baseline no
    lower than what is observed: 0; a baseline of 1: 1.
    """
    ints = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda t: F.xxhash64(t))
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.lit(":"), F.lpad(F.col("id").cast("string"), 24, "0"))
    placed = running_id(df.select(F.lit(0).alias("circle"), order.alias("place"), ints("a").alias("a"), ints("b").alias("b")), "circle", "place", "i").withColumn("i", F.col("i") - 1)
    n = placed.count()
    steps = min(shifts, n - 1)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        ours = pdf[pdf.ours]
        later = {i: frozenset(b) for i, b in zip(pdf.i, pdf.b, strict=True)}
        observed = random = 0.0
        for i, a in zip(ours.i, map(frozenset, ours.a), strict=True):
            observed += _jaccard(a, later[i])
            random += sum(_jaccard(a, later[(i + s) % n]) for s in range(1, steps + 1))
        return pd.DataFrame({"items": [len(ours)], "observed": [observed], "random": [random]})

    at = lambda x: F.floor(x / block).cast("long")
    before = F.transform(F.sequence(F.lit(0), F.lit(max(steps, 0))), lambda s: at(F.pmod(F.col("i") - s, F.lit(max(n, 1)))))
    spread = placed.withColumn("block", F.explode(F.array_distinct(before))).withColumn("ours", F.col("block") == at(F.col("i")))
    lean = spread.select("block", "i", "ours", F.when(F.col("ours"), F.col("a")).alias("a"), "b")
    total = lean.groupBy("block").applyInPandas(sums, "items long, observed double, random double").agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.sum("observed").alias("o"), F.sum("random").alias("r"))
    o = F.col("o") / F.col("items")
    r = F.try_divide(F.col("r"), F.col("items") * max(steps, 0))
    value = F.when(r.isNull() | o.isNull(), 0.0).when(r >= 1, 1.0).when(r >= o, 0.0).otherwise((o - r) / (1 - r))
    return total.select("items", F.round(o, 6).alias("jaccard_observed"), F.round(r, 6).alias("jaccard_random"), F.round(value, 6).alias("nsi"))


def _jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    union = len(a) + len(b) - both
    return both / union if union else 1.0


# ---- several runs over the same items: item, run, subdomains, terms, confidence, is_valid


def run_pairs(runs: DataFrame) -> DataFrame:
    """item, run_a, run_b, a, b, valid of all pairs of an item's runs; an item is grouped once, whatever the number of runs."""
    one = F.struct("run", "subdomains", "terms", "confidence", "is_valid")
    items = runs.groupBy("item").agg(F.array_sort(F.collect_list(one)).alias("r"))
    later = F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y.run > x.run), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = items.select("item", F.explode(F.flatten(later)).alias("p"))
    return pairs.select("item", F.col("p.a.run").alias("run_a"), F.col("p.b.run").alias("run_b"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), (F.col("p.a.is_valid") & F.col("p.b.is_valid")).alias("valid"))


def pair_agreement(pairs: DataFrame, parents: Column | None = None, soft: bool = False) -> DataFrame:
    """Raw, soft and parent-level Jaccard of each pair; null where a run is not valid.

    ``parents`` maps labels to parents; without it agreement of parents is that of the labels.  ``soft`` adds the
    matching of similar terms, which needs Python.
    """
    both = lambda f, c: F.when(F.col("valid"), f(F.col(f"a.{c}"), F.col(f"b.{c}")))
    up = (lambda a, b: hierarchical(a, b, parents)) if parents is not None else jaccard_full
    more = [both(soft_jaccard, "terms").alias("soft_jaccard_terms"), both(soft_jaccard, "subdomains").alias("soft_jaccard_subdomains")] if soft else []
    return pairs.select("item", "run_a", "run_b", both(jaccard_full, "subdomains").alias("raw_jaccard_subdomains"), both(jaccard_full, "terms").alias("raw_jaccard_terms"), both(up, "subdomains").alias("hierarchical_agreement"), *more)


MEASURES = ["raw_jaccard_subdomains", "raw_jaccard_terms", "hierarchical_agreement", "soft_jaccard_terms", "soft_jaccard_subdomains", "nsi"]


def pair_metrics(agreed: DataFrame) -> DataFrame:
    """A row a pair of runs: the items that count, and the mean of each measure over them."""
    found = [m for m in MEASURES if m in agreed.columns]
    return agreed.groupBy("run_a", "run_b").agg(F.count("raw_jaccard_terms").alias("items"), *(F.avg(m).alias(m) for m in found))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """The mean of each measure over the pairs of runs; a measure that a pair could not give (null) does not count."""
    found = [m for m in MEASURES if m in metrics.columns]
    return metrics.agg(F.count(F.lit(1)).alias("pairs"), *(F.round(F.avg(m), 6).alias(m) for m in found))


def run_consensus(runs: DataFrame, subdomains: int = 3, terms: int = 12) -> DataFrame:
    """item, runs, subdomains, terms, confidence, is_valid over any number of runs of an item.

    What all valid runs hold, filled in order from what any holds; the mean confidence.  One valid run
    stands as it is, none gives empty lists and confidence 0.
    """
    ok = F.col("is_valid")
    items = runs.groupBy("item").agg(F.count(F.when(ok, 1)).alias("runs"), F.avg(F.when(ok, F.col("confidence"))).alias("confidence"), *(F.collect_list(F.when(ok, F.col(c))).alias(c) for c in ("subdomains", "terms")))

    def agreed(c: str, most: int) -> Column:
        sets = F.transform(c, lambda x: F.array_distinct(x))
        every = F.aggregate(sets, F.element_at(sets, 1), lambda s, x: F.array_intersect(s, x))
        rest = F.array_sort(F.array_except(F.array_distinct(F.flatten(sets)), every))
        several = F.array_sort(F.slice(F.concat(F.array_sort(every), rest), 1, most))
        return F.when(F.col("runs") == 0, F.array().cast("array<string>")).when(F.col("runs") == 1, F.element_at(c, 1)).otherwise(several)

    return items.select("item", "runs", agreed("subdomains", subdomains).alias("subdomains"), agreed("terms", terms).alias("terms"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.col("runs") > 0).alias("is_valid"))


STABLE = {"soft_jaccard_terms": 0.75, "nsi": 0.65, "hierarchical_agreement": 0.80}
QUALITY = {"coverage": 0.95, "anchored_percent": 0.50}
BOUNDS = {"modality_fidelity": 0.05, "language_fidelity": 0.05, "deduplication_rate": 0.10}


def failed_floors(metrics: DataFrame, floors: dict[str, float], bounds: dict[str, float] | None = None) -> Column:
    """Names of measures that are missing or below their floor, or beyond their bound either way, in order of name."""
    names = [F.when(F.coalesce(F.col(m) < f, F.lit(True)), F.lit(m)) for m, f in floors.items() if m in metrics.columns]
    names += [F.when(F.abs(F.col(m)) > f, F.lit(m)) for m, f in (bounds or {}).items() if m in metrics.columns]
    return F.array_sort(F.filter(F.array(*names), lambda x: x.isNotNull())) if names else F.array().cast("array<string>")


def consensus_terms(df: DataFrame, most: int = 12) -> DataFrame:
    return df.select("id", consensus(F.col("a"), F.col("b"), most).alias("terms"))


def hierarchical(a: Column, b: Column, parents: Column) -> Column:
    """Jaccard of two label sets after mapping to parents; a label without a parent is its own."""
    up = lambda x: F.array_distinct(F.transform(x, lambda t: F.coalesce(parents[t], t)))
    return jaccard_full(up(a), up(b))


def quality(df: DataFrame, source_multimodal: Column | None = None, extracted_multimodal: Column | None = None) -> DataFrame:
    """Coverage, anchored share, shift of the multimodal share and duplicates of extraction records (terms, anchored_count, is_valid)."""
    n_terms = F.sum(F.greatest(F.size("terms"), F.lit(0)))
    share = lambda c: F.avg(c.cast("double"))
    shift = share(extracted_multimodal) - share(source_multimodal) if source_multimodal is not None else F.lit(0.0)
    return df.agg(
        F.round(F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)), 6).alias("coverage"),
        F.round(F.coalesce(shift, F.lit(0.0)), 6).alias("modality_fidelity"),
        F.round(F.least(F.coalesce(F.try_divide(F.sum("anchored_count"), n_terms), F.lit(0.0)), F.lit(1.0)), 6).alias("anchored_percent"),
        F.round(1 - F.try_divide(F.countDistinct("terms"), F.count(F.lit(1))), 6).alias("duplicate_share"),
    )
