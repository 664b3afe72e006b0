"""Queries over items: profiles, validation, order-dependent operators, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import card, planning, rules, views, windows
from evalloom.operators.views import ITEMS, QUESTIONS, read
from evalloom.plans.registry import query

WS = r"'^\s+|\s+$'"


@query("scan_project_items", f"with {ITEMS} select id::varchar id, upper(\"language\") lang, coalesce(nullif(\"domain\", ''), 'unknown') \"domain\", length(question) n_chars, left(question, 40) head from v_items")
def scan_project_items(spark, sf):
    return views.items(spark, sf).select(F.col("id").cast("string").alias("id"), F.upper("language").alias("lang"), F.coalesce(T.nz(F.col("domain")), F.lit("unknown")).alias("domain"), F.length("question").cast("long").alias("n_chars"), F.left("question", F.lit(40)).alias("head"))


@query("profile_language", f"with {ITEMS} select \"language\", count(*) n, sum(n_chars)::bigint chars, min(length(question)) shortest, max(length(question)) longest from v_items group by 1")
def profile_language(spark, sf):
    return views.items(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min(F.length("question")).cast("long").alias("shortest"), F.max(F.length("question")).cast("long").alias("longest"))


@query("profile_purity", f"""with {ITEMS}, c as (select "domain", "language", count(*) n from v_items group by 1, 2),
 r as (select *, row_number() over (partition by "domain" order by n desc, "language") k, sum(n) over (partition by "domain") total from c)
 select "domain", "language" as main_language, total::bigint total, round(n / total, 6) purity from r where k = 1""")
def profile_purity(spark, sf):
    counts = views.items(spark, sf).groupBy("domain", "language").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("domain").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "language")).alias("m"))
    return best.select("domain", F.col("m.language").alias("main_language"), "total", F.round(-F.col("m.k") / F.col("total"), 6).alias("purity"))


ISSUES = f"""with {ITEMS}, q as (select *, regexp_replace(coalesce(question, ''), {WS}, '', 'g') t from v_items),
 issues as (select id item_id, 'error' severity, 'missing_question' category, 'question is empty' message, 'question' field from q where t = ''
 union all select id, 'warning', 'short_question', 'question is shorter than 40 characters', 'question' from q where t <> '' and length(t) < 40
 union all select id, 'error', 'missing_language', 'language is empty', 'language' from q where coalesce("language", '') = ''
 union all select id, 'warning', 'language_mismatch', 'language is not en', 'language' from q where coalesce("language", '') <> 'en')"""


@query("validate_items", f"{ISSUES} select * from issues")
def validate_items(spark, sf):
    return rules.issues(views.items(spark, sf), "id", rules.item_rules("en", least=40))


@query("validation_report", f"""{ISSUES} select (select count(*) from v_items) total, (select count(distinct item_id) from issues where severity = 'error') failed,
 (select count(*) from issues where severity = 'warning') warnings, (select count(*) from issues) issues""")
def validation_report(spark, sf):
    items = views.items(spark, sf)
    found = rules.flags(rules.item_rules("en", least=40))
    errors = F.arrays_overlap("f", F.array(F.lit("missing_question"), F.lit("missing_language")))
    warn = F.size(F.filter("f", lambda x: x.isin("short_question", "language_mismatch")))
    return items.select(found.alias("f")).agg(F.count(F.lit(1)).alias("total"), F.count_if(errors).alias("failed"), F.coalesce(F.sum(warn), F.lit(0)).cast("long").alias("warnings"), F.coalesce(F.sum(F.size("f")), F.lit(0)).cast("long").alias("issues"))


@query("field_completeness", """select round(avg((coalesce(text, '') <> '')::int), 6) "text", round(avg((coalesce(lang, '') <> '')::int), 6) lang, round(avg((coalesce(source, '') <> '')::int), 6) source, round(avg((coalesce(n_chars, 0) <> 0)::int), 6) n_chars from documents""")
def field_completeness(spark, sf):
    ratio = lambda c, kind="string": F.round(F.avg(T.nz(F.col(c), kind).isNotNull().cast("int")), 6).alias(c)
    return read(spark, sf, "documents").agg(ratio("text"), ratio("lang"), ratio("source"), ratio("n_chars", "number"))


@query("left_join_labels", "select d.doc_id, d.source, coalesce(l.quality, -1)::int quality, coalesce(l.toxic, 0)::int toxic, l.doc_id is not null labelled from documents d left join labels l on l.doc_id = d.doc_id")
def left_join_labels(spark, sf):
    labels = read(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("labelled"))
    return read(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("static_quality_flags", f"""with {QUESTIONS}, n as (select *, regexp_replace(regexp_replace(lower(coalesce(stem, '')), {WS}, '', 'g'), '\\s+', ' ', 'g') stem_norm from v_questions),
 s as (select *, count(*) over (partition by stem_norm) n_same from n),
 f as (select question_id, list_filter([case when n_same > 1 and stem_norm <> '' then 'duplicate_stem' end, case when stem_norm = '' then 'empty_stem' end, case when quality is null then 'missing_label' end,
 case when stem_norm <> '' and length(stem_norm) < 20 then 'short_stem' end, case when secs > 600 or secs < 10 then 'time_out_of_range' end], lambda x: x is not null) f from s)
 select question_id, array_to_string(list_sort(f), ',') flags, case when list_contains(f, 'empty_stem') then 'broken_static' else 'candidate' end status from f""")
def static_quality_flags(spark, sf):
    rows = rules.duplicate_stem(views.questions(spark, sf), "stem")
    norm = F.col("stem_norm")
    found = rules.flags([
        rules.Rule("empty_stem", norm == ""),
        rules.Rule("duplicate_stem", (F.col("n_same") > 1) & (norm != "")),
        rules.Rule("missing_label", F.col("quality").isNull()),
        rules.Rule("short_stem", (norm != "") & (F.length(norm) < 20)),
        rules.Rule("time_out_of_range", ~F.col("secs").between(10, 600)),
    ])
    return rows.select("question_id", F.array_join(found, ",").alias("flags"), rules.static_status(found, ["empty_stem"]).alias("status"))


@query("duplicate_stem_flag", f"""with {QUESTIONS}, n as (select question_id, regexp_replace(regexp_replace(lower(coalesce(stem, '')), {WS}, '', 'g'), '\\s+', ' ', 'g') stem_norm from v_questions)
 select question_id, stem_norm, count(*) over (partition by stem_norm) n_same from n""")
def duplicate_stem_flag(spark, sf):
    return rules.duplicate_stem(views.questions(spark, sf), "stem").select("question_id", "stem_norm", "n_same")


@query("dedupe_first_stem", f"""with {QUESTIONS}, n as (select question_id, regexp_replace(regexp_replace(lower(coalesce(stem, '')), {WS}, '', 'g'), '\\s+', ' ', 'g') stem_norm from v_questions)
 select stem_norm, min(question_id) question_id from n group by 1""")
def dedupe_first_stem(spark, sf):
    # The first row of each stem as a minimum, which combines before the shuffle.
    return views.questions(spark, sf).select(T.normalize_stem(F.col("stem")).alias("stem_norm"), "question_id").groupBy("stem_norm").agg(F.min("question_id").alias("question_id"))


@query("dup_id_suffix", """with n as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role) - 1 k from conversations)
 select conv_id, turn, case when k = 0 then conv_id::varchar else conv_id || '_dup' || k end unique_id from n""")
def dup_id_suffix(spark, sf):
    return windows.dup_suffix(read(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "unique_id")


@query("trim_over_quota", f"""with {QUESTIONS}, r as (select *, count(*) over w n, row_number() over (partition by super_parent, design_type order by difficulty, secs, question_id) k from v_questions window w as (partition by super_parent, design_type))
 select super_parent, design_type, question_id from r where k > n - case when design_type = 'standard' then 30 else 2 end""")
def trim_over_quota(spark, sf):
    quotas = spark.createDataFrame([("standard", 30), ("adversarial", 2)], "design_type string, quota int")
    rows = views.questions(spark, sf)
    return windows.trim_over_quota(rows, quotas, ["design_type"], "quota", "difficulty", "secs", "question_id", group=["super_parent", "design_type"]).select("super_parent", "design_type", "question_id")


@query("largest_remainder", f"""with {QUESTIONS}, shares(difficulty, share) as (values ('L1', 0.15::double), ('L2', 0.25::double), ('L3', 0.30::double), ('L4', 0.20::double), ('L5', 0.10::double)),
 t as (select super_parent, count(*) total from v_questions group by 1),
 e as (select super_parent, difficulty, total, round(share * total, 9) exact from t, shares),
 f as (select *, floor(exact)::bigint whole, round(exact - floor(exact), 9) frac from e),
 r as (select *, row_number() over (partition by super_parent order by frac desc, difficulty) k, total - sum(whole) over (partition by super_parent) spare from f)
 select super_parent, difficulty, total, (whole + (k <= spare)::bigint)::bigint units from r""")
def largest_remainder_query(spark, sf):
    totals = views.questions(spark, sf).groupBy("super_parent").agg(F.count(F.lit(1)).alias("total"))
    rows = totals.withColumn("s", F.array(*(F.struct(F.lit(k).alias("difficulty"), F.lit(v).alias("share")) for k, v in planning.CS_COVERAGE.difficulty.items()))).select("super_parent", "total", F.inline("s"))
    return windows.allocate(rows, ["super_parent"], "share", F.col("total"), "difficulty").select("super_parent", "difficulty", "total", "units")


@query("greedy_deficit_fill", f"""with {QUESTIONS}, c as (select super_parent, difficulty, count(*) n from v_questions group by 1, 2), d as (select *, greatest(0, 12 - n) need from c),
 r as (select *, coalesce(sum(need) over (partition by super_parent order by difficulty rows between unbounded preceding and 1 preceding), 0) before from d)
 select super_parent, difficulty, n, need::bigint need, least(need, greatest(0, 8 - before))::bigint given from r""")
def greedy_deficit_fill(spark, sf):
    counts = views.questions(spark, sf).groupBy("super_parent", "difficulty").agg(F.count(F.lit(1)).alias("n")).withColumn("need", F.greatest(F.lit(0), 12 - F.col("n")).cast("long"))
    return windows.greedy_fill(counts, ["super_parent"], "need", F.lit(8), "difficulty")


@query("deficits", f"""with {QUESTIONS}, c as (select super_parent, design_type, count(*) actual from v_questions group by 1, 2),
 q as (select distinct source super_parent, design_type, case when design_type = 'standard' then 45 else 5 end quota from documents, (values ('standard'), ('adversarial')) v(design_type))
 select q.super_parent, q.design_type, quota, coalesce(actual, 0) actual, greatest(0, quota - coalesce(actual, 0))::bigint deficit from q left join c on c.super_parent = q.super_parent and c.design_type = q.design_type""")
def deficits(spark, sf):
    both = F.array(F.struct(F.lit("standard").alias("design_type"), F.lit(45).alias("quota")), F.struct(F.lit("adversarial").alias("design_type"), F.lit(5).alias("quota")))
    quotas = read(spark, sf, "documents").select(F.col("source").alias("super_parent")).distinct().select("super_parent", F.inline(both))
    actual = views.questions(spark, sf).groupBy("super_parent", "design_type").agg(F.count(F.lit(1)).alias("actual"))
    return planning.deficits(quotas, actual, ["super_parent", "design_type"])


@query("quota_vs_actual", f"""with {QUESTIONS}, c as (select difficulty, count(*) actual from v_questions group by 1), t as (select count(*) n from v_questions),
 e(difficulty, share) as (values ('L1', 0.15::double), ('L2', 0.25::double), ('L3', 0.30::double), ('L4', 0.20::double), ('L5', 0.10::double))
 select e.difficulty, floor(n * share)::bigint expected, coalesce(actual, 0) actual, abs(coalesce(actual, 0) - floor(n * share)) > 5 deviates from e cross join t left join c on c.difficulty = e.difficulty""")
def quota_vs_actual(spark, sf):
    rows = views.questions(spark, sf)
    shares = spark.createDataFrame(list(planning.CS_COVERAGE.difficulty.items()), "difficulty string, share double")
    n = rows.count()
    actual = rows.groupBy("difficulty").agg(F.count(F.lit(1)).alias("actual"))
    got = F.broadcast(shares).join(actual, "difficulty", "left").select("difficulty", F.floor(F.col("share") * n).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
    return got.withColumn("deviates", planning.deviation(F.col("actual"), F.col("expected"), 5))


@query("topk_per_parent", f"""with {ITEMS}, r as (select "domain", id, n_chars, row_number() over (partition by "domain" order by n_chars desc, id) rank from v_items) select * from r where rank <= 5""")
def topk_per_parent(spark, sf):
    return windows.top_k(views.items(spark, sf).select("domain", "id", "n_chars"), ["domain"], 5, F.desc("n_chars"), "id")


@query("first_n_samples", f"""with {ITEMS}, r as (select "domain", id, row_number() over (partition by "domain" order by id) rank from v_items) select * from r where rank <= 2""")
def first_n_samples(spark, sf):
    return windows.top_k(views.items(spark, sf).select("domain", "id"), ["domain"], 2, "id")


@query("chunk_batches", f"""with {ITEMS}, r as (select "domain", id, (floor((row_number() over (partition by "domain" order by id) - 1) / 16) + 1)::bigint batch from v_items)
 select "domain", batch, count(*) n, min(id) first_id, max(id) last_id from r group by 1, 2""")
def chunk_batches(spark, sf):
    return windows.batches(views.items(spark, sf).select("domain", "id"), ["domain"], 16, "id").groupBy("domain", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("gini_by_source", f"""with c as (select lang, source, count(*) n from documents group by 1, 2), r as (select *, row_number() over (partition by lang order by n) i from c)
 select lang, round(coalesce(2 * sum(i * n)::double / nullif(count(*) * sum(n), 0)::double - (count(*) + 1)::double / count(*), 0), 6) gini, count(*) n_groups from r group by 1""")
def gini_by_source(spark, sf):
    counts = read(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return windows.gini(counts, "n", ["lang"])


@query("sunburst_nodes", """with r as (select source, lang, count(*) value, grouping(source) gs, grouping(lang) gl from documents group by rollup (source, lang))
 select case when gs = 1 then 'root' when gl = 1 then source else source || '/' || lang end id, case when gs = 1 then '' when gl = 1 then 'root' else source end up, value from r""")
def sunburst_nodes(spark, sf):
    return card.sunburst(read(spark, sf, "documents"), "source", "lang")


@query("domain_card_rollup", """with t as (select doc_id, source, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) term from documents),
 c as (select source, term, count(*) n from t group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, term) k from c),
 w as (select source, string_agg(term, ',' order by k) typical_terms from r where k <= 15 group by 1),
 s as (select source, doc_id, row_number() over (partition by source order by doc_id) k from documents),
 f as (select source, string_agg(doc_id::varchar, ',' order by doc_id) samples from s where k <= 2 group by 1)
 select d.source, count(*) records, w.typical_terms, f.samples from documents d left join w on w.source = d.source left join f on f.source = d.source group by d.source, w.typical_terms, f.samples""")
def domain_card_rollup(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("terms"))
    r = card.rollup(docs, "source", "lang", "terms", "doc_id")
    return r.select("source", "records", F.array_join("typical_terms", ",").alias("typical_terms"), F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("label_frequency", "select source, lang, coalesce(quality, -1)::int quality, count(*) n from documents d left join labels l on l.doc_id = d.doc_id group by 1, 2, 3")
def label_frequency(spark, sf):
    labels = read(spark, sf, "labels").select("doc_id", "quality")
    return read(spark, sf, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left").groupBy("source", "lang", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_deterministic", f"with {ITEMS} select * from v_items order by md5('42:' || id::varchar), id limit case when (select count(*) from v_items) <= 200 then 1000000000 else 200 end")
def sample_deterministic(spark, sf):
    """A seeded sample: choosing rows is what this operator is for."""
    return windows.sample(views.items(spark, sf), 200, 42, "id")


@query("batch_plan", f"""with recursive {QUESTIONS}, q as (select coalesce(super_parent, '') parent, count(*) filter (design_type = 'standard') s, count(*) filter (design_type = 'adversarial') a from v_questions group by 1),
 b as (select parent, 0::bigint idx, s, a, 0::bigint standard, 0::bigint adversarial from q union all
  select parent, idx + 1, s - (least(20, s + a) - greatest(x, 0)), a - x, least(20, s + a) - x, x from (select *, least(a, least(20, s + a) - least(s, round_even(least(20, s + a) * s::double / (s + a), 0)::bigint)) x from b where s + a > 0))
 select 'quota_' || parent || '_' || case when idx < 1000 then lpad(idx::varchar, 3, '0') else idx::varchar end batch_id, parent, idx, standard, adversarial from b where idx > 0""")
def batch_plan(spark, sf):
    """Batches of 20 questions for as many questions of each parent and design as there are."""
    one = lambda d: F.count(F.when(F.col("design_type") == d, 1))
    quotas = views.questions(spark, sf).groupBy(F.coalesce("super_parent", F.lit("")).alias("parent")).agg(one("standard").alias("standard"), one("adversarial").alias("adversarial"))
    return planning.quota_batches(quotas, "quota")

