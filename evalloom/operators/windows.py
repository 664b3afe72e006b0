"""Order-dependent operators: first wins, suffixes, quotas, top-k, batches, samples.

Order is always a data column; nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.lineage import stored


def first_by(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each group: the last duplicate wins."""
    return first_by(df, keys, F.desc(order))


def dup_suffix(df: DataFrame, key: str, *order: str | Column, alias: str = "unique_id") -> DataFrame:
    """Later rows of a key get ``_dup1``, ``_dup2`` and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(alias, F.when(n == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_dup"), n.cast("string"))))


def top_k(df: DataFrame, keys: list[str], k: int, *order: str | Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def numbered(df: DataFrame, keys: list[str], *order: str | Column, alias: str = "place") -> DataFrame:
    """1-based places of the rows of each group in rising order, by ``running_id``: no task holds a group."""
    named = df.withColumns({"_group": F.struct(*keys), "_order": F.struct(*order)})
    return running_id(named, "_group", "_order", alias).drop("_group", "_order")


def trim_over_quota(df: DataFrame, quotas: DataFrame, keys: list[str], quota: str, *easiest_first: str | Column, group: list[str] | None = None) -> DataFrame:
    """Of a group (by default the quota's keys) above its quota, the first rows in the given rising order go."""
    rows = df.join(quotas, keys)
    placed = numbered(rows, group or keys, *easiest_first, alias="_r").withColumn("_g", F.struct(*(group or keys)))
    sizes = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_g", "_group")
    got = placed.join(sizes, F.col("_g").eqNullSafe(F.col("_group")))
    return got.where(F.col("_r") > F.col("_n") - F.col(quota)).select(*(c for c in rows.columns if c != quota))


def allocate(shares: DataFrame, group: list[str], share: str, total: Column, order: str, alias: str = "units") -> DataFrame:
    """Largest remainder by group: spare units go to the largest fractions, earlier rows first.

    Fractions are rounded to 9 places, so that binary noise does not decide a tie.
    """
    exact = F.round(F.col(share) * total, 9)
    w = Window.partitionBy(*group)
    rows = shares.withColumn("_floor", F.floor(exact).cast("long")).withColumn("_frac", F.round(exact - F.floor(exact), 9))
    spare = total.cast("long") - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("_frac"), order))
    return rows.withColumn(alias, (F.col("_floor") + (rank <= spare).cast("long")).cast("long")).drop("_floor", "_frac")


def greedy_fill(df: DataFrame, group: list[str], need: str, capacity: Column, order: str, alias: str = "given") -> DataFrame:
    """Needs are met in order until the capacity is used up."""
    before = F.coalesce(F.sum(need).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(alias, F.least(F.col(need), F.greatest(F.lit(0), capacity - before)).cast("long"))


def batches(df: DataFrame, keys: list[str], size: int, *order: str | Column) -> DataFrame:
    """1-based batch numbers of fixed size within each group, in rising order."""
    return numbered(df, keys, *order, alias="_r").withColumn("batch", (F.floor((F.col("_r") - 1) / size) + 1).cast("long")).drop("_r")


def seeded(seed: int, id_col: str) -> Column:
    """A digest that orders rows at random, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample(df: DataFrame, n: int, seed: int, id_col: str, minimum: int = 0) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the identifier; all rows of a table that is not larger."""
    size = df.count()
    if size <= max(n, minimum):
        return df
    return df.orderBy(seeded(seed, id_col), id_col).limit(n)


def sample_by(df: DataFrame, keys: list[str], n: int, seed: int, id_col: str) -> DataFrame:
    return top_k(df, keys, n, seeded(seed, id_col), F.col(id_col)).drop("rank")


def running_id(df: DataFrame, key: str, order: str, alias: str = "running_id") -> DataFrame:
    """1-based numbers of the rows of each key in order, without a window over a whole key.

    Rows are dealt by ranges of key and order and stored; a range's rows are numbered on their own and the
    counts of the ranges before are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, key, order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).withColumnRenamed(key, "_key").withColumnRenamed("_p", "_range")
    local = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p", key).orderBy(order)))
    got = local.join(counts, (F.col("_p") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")))
    return got.withColumn(alias, F.col("_before") + F.col("_i")).select(*df.columns, alias)


def gini(df: DataFrame, count: str, group: list[str] | None = None) -> DataFrame:
    """Gini of counts, over sorted values."""
    keys = group or []
    w = Window.partitionBy(*keys).orderBy(count) if keys else Window.partitionBy(F.lit(0)).orderBy(count)
    ranked = df.withColumn("_i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum(count)
    value = F.try_divide(2 * F.sum(F.col("_i") * F.col(count)), n * total) - (n + 1) / n
    return ranked.groupBy(*keys).agg(F.round(F.coalesce(value, F.lit(0.0)), 6).alias("gini"), n.alias("n_groups"))
