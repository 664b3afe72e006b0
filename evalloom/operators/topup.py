"""Top-up rounds over tables: how much each parent gets, what is drawn from shared deficits, which rows answer.

All steps are windows and joins over one row a parent; questions are only ranked within parent and design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.lineage import stored
from evalloom.operators.windows import allocate


def targets(lacking: DataFrame, remaining: Column, order: str = "parent", per_call: int = 20, fallback: int = 5, most: int = 20) -> DataFrame:
    """parent, total, standard, adversarial of every parent that gets a batch this round.

    ``lacking`` has parent, standard, adversarial (what is missing) and the columns of ``remaining`` (what the dataset
    lacks in all).  Parents come in order; each takes what it needs, at most a batch, as long as something remains; one
    that needs nothing takes a fallback while something remains.  What earlier parents took is a running sum.
    """
    need = F.col("standard") + F.col("adversarial")
    want = F.when(need > 0, F.least(need, F.lit(per_call), F.lit(most))).otherwise(F.lit(min(fallback, per_call, most)))
    before = F.coalesce(F.sum("_want").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a parent
    rows = lacking.withColumn("_want", want).withColumn("_left", F.greatest(F.lit(0), remaining - before))
    total = F.when(F.col("_left") > 0, F.greatest(F.lit(1), F.least("_want", "_left"))).when(need > 0, F.greatest(F.lit(1), F.col("_want")))
    rows = rows.withColumn("total", total).where("total is not null")
    std = F.least("standard", "total")
    adv = F.least(F.col("adversarial"), F.col("total") - std)
    return rows.select("parent", F.col("total").cast("long").alias("total"), (F.col("total") - adv).cast("long").alias("standard"), adv.cast("long").alias("adversarial"))


def draw(requests: DataFrame, deficits: DataFrame, order: str = "parent") -> DataFrame:
    """parent, key, units: what each request (parent, total) takes of deficits (key, pos, deficit, share) that all share.

    Requests come in order and take from the keys in order of ``pos``: laid end to end, a request takes of a key
    what their stretches have in common.  What no deficit covers is allocated by the keys' shares.
    """
    keys = deficits.withColumn("_to", F.sum("deficit").over(Window.orderBy("pos")))
    keys = keys.select("key", "pos", "share", (F.col("_to") - F.col("deficit")).alias("_from"), "_to", F.sum("deficit").over(Window.partitionBy()).alias("_all"))  # a row a key of the config
    listed = keys.agg(F.array_sort(F.collect_list(F.struct("pos", "key", "share", "_from", "_to", "_all"))).alias("_k"), F.lit(0).alias("_one"))
    placed = requests.withColumn("_stop", F.sum("total").over(Window.orderBy(order))).withColumn("_start", F.col("_stop") - F.col("total")).withColumn("_one", F.lit(0))
    pairs = placed.join(F.broadcast(listed), "_one").select("parent", "total", "_start", "_stop", F.explode("_k").alias("k")).select("parent", "total", "_start", "_stop", "k.*")
    shared = F.greatest(F.lit(0), F.least("_stop", "_to") - F.greatest("_start", "_from"))
    rest = F.greatest(F.lit(0), F.col("_stop") - F.greatest("_start", F.col("_all")))
    spread = allocate(pairs.withColumn("_drawn", shared).withColumn("_rest", rest), ["parent"], "share", F.col("_rest"), "pos", "_more")
    return spread.select("parent", "key", (F.col("_drawn") + F.col("_more")).cast("long").alias("units"))


def answered(requests: DataFrame, pool: DataFrame, order: str = "generation_index") -> DataFrame:
    """The pool's rows that answer the requests: the first ones of each parent and design, as many as asked for."""
    asked = requests.select("parent", F.explode(F.array(*(F.struct(F.lit(d).alias("design"), F.col(d).alias("n")) for d in ("standard", "adversarial")))).alias("a")).select("parent", "a.design", "a.n").where("n > 0")
    ranked = pool.join(asked, ["parent", "design"]).withColumn("_r", F.row_number().over(Window.partitionBy("parent", "design").orderBy(order)))
    return ranked.where(F.col("_r") <= F.col("n")).drop("_r", "n")


def rounds(have: DataFrame, pool: DataFrame, quotas: DataFrame, most: int = 3, order: str = "generation_index", **limits: int) -> tuple[DataFrame, DataFrame]:
    """(all rows with the round they came in, 0 for the first; the requests of every round).

    ``have`` and ``pool`` hold parent, design and ``order``; ``quotas`` parent, standard, adversarial.  A round asks for what is lacking, takes
    rows of the pool that were not taken before, and is stored; it ends early when nothing is lacking or nothing is left to answer.
    """
    total = have.withColumn("round", F.lit(0))
    asked = None
    for k in range(1, most + 1):
        counts = total.groupBy("parent").agg(*(F.count(F.when(F.col("design") == d, 1)).alias(f"_{d}") for d in ("standard", "adversarial")))
        left = quotas.join(counts, "parent", "left").fillna(0, ["_standard", "_adversarial"])
        lacks = left.select("parent", *(F.greatest(F.lit(0), F.col(d) - F.col(f"_{d}")).alias(d) for d in ("standard", "adversarial")), (F.col("standard") + F.col("adversarial")).alias("_quota"), (F.col("_standard") + F.col("_adversarial")).alias("_have"))
        every = Window.partitionBy()
        lacks = lacks.withColumn("_remaining", F.greatest(F.lit(0), F.sum("_quota").over(every) - F.sum("_have").over(every)))  # a row a parent
        if not lacks.where("standard + adversarial > 0 or _remaining > 0").count():
            break
        requests = stored(targets(lacks, F.col("_remaining"), **limits), "requests")
        unused = pool.join(total.select("parent", "design", order), ["parent", "design", order], "left_anti")
        new = stored(answered(requests, unused, order), "answers")
        asked = requests.withColumn("round", F.lit(k)) if asked is None else asked.unionByName(requests.withColumn("round", F.lit(k)))
        if new.isEmpty():
            break
        total = total.unionByName(new.withColumn("round", F.lit(k)), allowMissingColumns=True)
    return total, asked
