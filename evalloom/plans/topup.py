"""Two top-up rounds over the questions: those of known good quality are there, the others can be asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import topup, views
from evalloom.operators.views import QUESTIONS
from evalloom.plans.registry import query

SHARES = {"L1": 0.15, "L2": 0.25, "L3": 0.30, "L4": 0.20, "L5": 0.10}
PER_CALL, FALLBACK = 20, 5

BASE = f"""{QUESTIONS}, q as (select coalesce(super_parent, '') parent, design_type design, difficulty, generation_index, coalesce(quality, 0) = 1 good from v_questions),
 quotas as (select parent, count(*) filter (design = 'standard') standard, count(*) filter (design = 'adversarial') + 2 adversarial from q group by 1), t0 as (select parent, design, difficulty, generation_index, 0 round from q where good)"""


def _round(k: int) -> str:
    t = f"t{k - 1}"
    return f"""c{k} as (select u.parent, u.standard, u.adversarial, count(t.parent) filter (design = 'standard') hs, count(t.parent) filter (design = 'adversarial') ha from quotas u left join {t} t on t.parent = u.parent group by all),
 l{k} as (select parent, greatest(0, standard - hs) standard, greatest(0, adversarial - ha) adversarial, greatest(0, sum(standard + adversarial) over () - sum(hs + ha) over ()) remaining from c{k}),
 w{k} as (select *, case when standard + adversarial > 0 then least(standard + adversarial, {PER_CALL}) else {FALLBACK} end want from l{k}),
 b{k} as (select *, greatest(0, remaining - coalesce(sum(want) over (order by parent rows between unbounded preceding and 1 preceding), 0)) rest from w{k}),
 g{k} as (select *, case when rest > 0 then greatest(1, least(want, rest)) when standard + adversarial > 0 then greatest(1, want) end total from b{k}),
 r{k} as (select parent, total::bigint total, (total - least(adversarial, total - least(standard, total)))::bigint standard, least(adversarial, total - least(standard, total))::bigint adversarial from g{k} where total is not null),
 p{k} as (select q.parent, q.design, q.difficulty, q.generation_index, row_number() over (partition by q.parent, q.design order by q.generation_index) i, case when q.design = 'standard' then r.standard else r.adversarial end n
   from q join r{k} r on r.parent = q.parent where not good and not exists (select 1 from {t} t where t.parent = q.parent and t.design = q.design and t.generation_index = q.generation_index)),
 t{k} as (select * from {t} union all select parent, design, difficulty, generation_index, {k} round from p{k} where i <= n)"""


def _tables(spark, sf):
    q = views.questions(spark, sf).select(F.coalesce("super_parent", F.lit("")).alias("parent"), F.col("design_type").alias("design"), "difficulty", "generation_index", (F.coalesce("quality", F.lit(0)) == 1).alias("good"))
    one = lambda d: F.count(F.when(F.col("design") == d, 1))
    quotas = q.groupBy("parent").agg(one("standard").alias("standard"), (one("adversarial") + 2).alias("adversarial"))
    return q.where("good").drop("good"), q.where("not good").drop("good"), quotas


@query("topup_rounds", f"with {BASE}, {_round(1)}, {_round(2)} select parent, design, generation_index, round from t2")
def topup_rounds(spark, sf):
    """All questions after two rounds, with the round that each came in."""
    have, pool, quotas = _tables(spark, sf)
    total, _ = topup.rounds(have, pool, quotas, 2, per_call=PER_CALL, fallback=FALLBACK)
    return total.select("parent", "design", "generation_index", "round")


LEVELS = "lv as (select * from (values " + ", ".join(f"('{k}', {i}, {v}::double)" for i, (k, v) in enumerate(SHARES.items())) + ") v(key, pos, share))"


@query("topup_difficulty", f"""with {BASE}, {_round(1)}, {LEVELS}, h as (select difficulty key, count(*) n from t0 group by 1), z as (select sum(standard + adversarial) total from quotas),
 d as (select lv.*, greatest(0, floor(share * total)::bigint - coalesce(n, 0)) deficit from lv left join h on h.key = lv.key, z), k as (select *, sum(deficit) over (order by pos) t, sum(deficit) over () a from d),
 e as (select *, sum(total) over (order by parent) stop from r1), x as (select parent, key, pos, share, greatest(0, least(stop, t) - greatest(stop - total, t - deficit)) drawn, greatest(0, stop - greatest(stop - total, a)) rest from e, k),
 y as (select *, round(share * rest, 9) want from x), f as (select *, floor(want) base, round(want - floor(want), 9) frac from y), s as (select *, rest - sum(base) over (partition by parent) spare, row_number() over (partition by parent order by frac desc, pos) i from f)
 select parent, key, (drawn + base + (i <= spare)::int)::bigint units from s""")
def topup_difficulty(spark, sf):
    """What the first round's requests take of each level's deficit, in order; what none covers goes by the levels' shares."""
    have, pool, quotas = _tables(spark, sf)
    _, asked = topup.rounds(have, pool, quotas, 1, per_call=PER_CALL, fallback=FALLBACK)
    levels = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(SHARES.items())], "key string, pos int, share double")
    total = quotas.agg(F.sum(F.col("standard") + F.col("adversarial")).alias("_n"), F.lit(0).alias("_one"))
    held = have.groupBy(F.col("difficulty").alias("key")).agg(F.count(F.lit(1)).alias("_h"))
    deficits = levels.join(held, "key", "left").withColumn("_one", F.lit(0)).join(total, "_one").select("key", "pos", "share", F.greatest(F.lit(0), F.floor(F.col("share") * F.col("_n")).cast("long") - F.coalesce("_h", F.lit(0))).alias("deficit"))
    return topup.draw(asked, deficits)
