"""Clusters around leaders: in order, a row joins the first leader that is near enough, or leads.

The order is falling frequency, then the order columns.  A cluster's centre moves to a member only if that one is more
frequent than the cluster's best so far; in this order that cannot happen, so leaders stay where they are, and rows may
be compared with leaders in any order as long as the earliest near one wins.

Each round takes the first rows of every group that no leader has taken yet, about ``block`` of them, and passes over them in order in one task; what leads
there is compared with all later rows of its group, in cells of about ``block`` rows, and those near a new leader
leave with the earliest.  So no task holds more than a block and its leaders, whatever a group's size; a group takes about as many rounds as
it has blocks of leaders, and each round is stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.ivf import unit
from evalloom.operators.lineage import cut
from evalloom.operators.windows import running_id

BLOCK = 2048


def _near(rows: np.ndarray, leaders: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first leader that is near enough, or -1."""
    hit = rows @ leaders.T >= threshold - 1e-9
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def first_leaders(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """The position of each row's leader (its own, if it leads), in order."""
    out, lead = np.empty(len(vectors), np.int64), np.zeros(0, np.int64)
    for i, v in enumerate(vectors):
        near = np.flatnonzero(vectors[lead] @ v >= threshold - 1e-9)
        out[i] = lead[near[0]] if len(near) else i
        if not len(near):
            lead = np.append(lead, i)
    return out


def leader_clusters(df: DataFrame, group: str, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, frequency: Column | None = None, block: int = BLOCK) -> DataFrame:
    """id, cluster (its leader's id), total (frequency of the cluster), size of every row with a vector.

    Without ``frequency`` each row counts once and the order is that of the identifiers.
    """
    frequency = F.lit(1).cast("long") if frequency is None else F.coalesce(frequency.cast("long"), F.lit(0).cast("long"))
    kind = dict(df.dtypes)[id_col]
    plain = df.withColumn("_f", frequency).withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    rows = unit(plain.withColumn("_id", F.struct(F.col(id_col).alias("id"), F.col("_g").alias("g"), F.col("_f").alias("f"))), "_id", vector)
    order = F.struct((-F.col("id.f")).alias("f"), F.col("id.id").alias("id"))
    named = rows.select(F.col("id.g").alias("g"), F.col("id.id").alias("id"), F.col("id.f").alias("f"), "vector", order.alias("o"))
    rest = cut(running_id(named, "g", "o", "place").drop("o"))
    done = None

    def head_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        at = first_leaders(np.stack(pdf["vector"].to_numpy()), threshold)
        return pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "f": pdf["f"], "cluster": pdf["id"].to_numpy()[at], "place": pdf["place"], "lead": at == np.arange(len(at)), "chunks": pdf["chunks"], "vector": pdf["vector"]})

    def tail_pass(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = np.zeros(len(left), object)
        near = np.full(len(left), -1)
        if len(left) and len(right):
            right = right.sort_values("place")
            near = _near(np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy()), threshold)
            names = right["id"].to_numpy()[np.maximum(near, 0)]
        taken = pd.Series(names, index=left.index).where(near >= 0, None)
        return pd.DataFrame({"g": left["g"], "id": left["id"], "f": left["f"], "cluster": taken, "place": left["place"], "vector": left["vector"]})

    while True:
        # The first blocks of places of each group that together hold at most a block of rows, the first one always.
        blocks = rest.groupBy("g", F.floor((F.col("place") - 1) / block).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("k"))
        edge = blocks.withColumn("n", F.when(F.row_number().over(Window.partitionBy("g").orderBy("k")) == 1, 0).otherwise(upto)).where(F.col("n") <= block).groupBy("g").agg(((F.max("k") + 1) * block).alias("edge"))
        sized = rest.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
        marked = cut(rest.join(edge, "g").join(sized, "g").withColumn("head", F.col("place") <= F.col("edge")))
        if marked.isEmpty():
            break
        got = cut(marked.where("head").select("g", "id", "f", "vector", "place", "chunks").groupBy("g").applyInPandas(head_pass, f"g string, id {kind}, f long, cluster {kind}, place long, lead boolean, chunks int, vector array<double>"))
        found = got.select("g", "id", "f", "cluster")
        done = found if done is None else done.unionByName(found)
        tail = marked.where("not head").withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks")).cast("int"))
        if tail.isEmpty():
            break
        new = got.where("lead")
        new = new.select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "place", "vector")
        cells = tail.select("g", "chunk", "id", "f", "place", "vector").groupBy("g", "chunk").cogroup(new.groupBy("g", "chunk"))
        passed = cut(cells.applyInPandas(tail_pass, f"g string, id {kind}, f long, cluster {kind}, place long, vector array<double>"))
        done = done.unionByName(passed.where("cluster is not null").select("g", "id", "f", "cluster"))
        rest = passed.where("cluster is null").drop("cluster")
    if done is None:
        return rest.select("id", F.col("id").alias("cluster"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("size"))
    sums = done.groupBy("g", "cluster").agg(F.sum("f").alias("total"), F.count(F.lit(1)).alias("size"))
    return done.join(sums, ["g", "cluster"]).select("id", "cluster", "total", "size")
