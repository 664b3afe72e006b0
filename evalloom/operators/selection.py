"""Selection of configured entries (models, designers, datasets) by whatever spelling of their names is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import slugify, trim_ws


def spellings(c: Column) -> list[Column]:
    """A name as it is, in lower case, as a slug, as a slug without gaps, and in lower case without dashes: from exact to loose."""
    plain = F.lower(trim_ws(c))
    return [c, plain, slugify(c), F.replace(slugify(c), F.lit("_"), F.lit("")), F.translate(plain, "-_", "")]


def variants(entries: DataFrame, key: str, names: list[str]) -> DataFrame:
    """form, key, rank: every spelling of every name of an entry, names in order of preference."""
    forms = [F.struct(form.alias("form"), F.lit(k).alias("rank")) for k, form in enumerate(x for n in names for x in spellings(F.col(n).cast("string")))]
    rows = entries.select(F.col(key).alias("key"), F.explode(F.array(*forms)).alias("v")).where("v.form is not null and v.form <> ''")
    return rows.groupBy(F.col("v.form").alias("form"), "key").agg(F.min("v.rank").alias("rank"))


def select(asked: DataFrame, entries: DataFrame, name: str, key: str, names: list[str]) -> DataFrame:
    """asked, key, rank, candidates of every distinct name that is asked for: the entry with the closest spelling.

    ``rank`` counts spellings of the entry's names, exact ones of the first name first; several entries at the best
    rank are ``candidates``, of which the first by key is taken.  A name without any has a null key.
    """
    wanted = asked.select(F.col(name).cast("string").alias("asked")).where("asked is not null").distinct()
    forms = wanted.select("asked", F.explode(F.array_distinct(F.array(*spellings(F.col("asked"))))).alias("form"))
    found = forms.join(variants(entries, key, names), "form").groupBy("asked", "key").agg(F.min("rank").alias("rank"))
    best = found.groupBy("asked").agg(F.min(F.struct("rank", "key")).alias("b"))
    level = found.groupBy("asked", "rank").agg(F.count(F.lit(1)).alias("candidates"))
    taken = best.select("asked", F.col("b.key").alias("key"), F.col("b.rank").alias("rank")).join(level, ["asked", "rank"])
    return wanted.join(taken, "asked", "left").select("asked", "key", "rank", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))
