"""Connected components of a link table, with alternating large-star and small-star steps.

Steps go on until nothing changes, some logarithm of the longest chain.  Every step is a grouped minimum with map-side combining and a join; nothing reaches the driver but a
count.  Each step's links are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node that it reaches) of every node that has a link.  Self-links and repeats are allowed."""
    now = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    now = materialise(now, "links")
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        small_min = large.groupBy("v").agg(F.min("u").alias("m"))
        nxt = large.join(small_min, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        nxt = materialise(nxt, "links")
        # Done when every larger node has one smaller neighbour and no smaller node is a larger one.
        roots = nxt.select(F.col("u").alias("k"), F.lit(1).alias("s")).unionByName(nxt.select(F.col("v").alias("k"), F.lit(2).alias("s")))
        mixed = roots.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.when(F.col("s") == 2, 1)).alias("n"))
        open_ = mixed.where("lo <> hi or n > 1").limit(1).count()
        discard(links.sparkSession, now)
        now = nxt
        if not open_:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
