"""Queries of items and extraction records over the texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import items, taxonomy, views
from evalloom.operators.views import ANSWERS, QUESTIONS, read
from evalloom.plans.registry import query
from evalloom.plans.texts import _words

VISUAL = "regexp_matches(text, '(?i)\\b(image|diagram|figure|picture|graph|chart|photo|draw|visual)\\b')"


@query("split_characteristics", f"""with i as (select coalesce(source, '') split, coalesce(d.lang, 'Unknown') l, case l.quality when 1 then 'MCQ' when 0 then 'Open' else 'Unknown' end f, coalesce({VISUAL}, false) m, nullif(string_split(coalesce(text, ''), ' ')[1], '') s, coalesce(contains(p.html, '<img'), false) g
  from documents d left join labels l on l.doc_id = d.doc_id left join pages p on p.page_id = d.doc_id), t as (select split, count(*) total, count(*) filter (m) v, count(distinct s) subs, bool_or(g) g from i group by 1),
 e as (select source split, count(*) n from documents where text is not null and length(text) > 100 group by 1),
 a as (select split, l, count(*) n, row_number() over (partition by split order by count(*) desc, l) k from i group by 1, 2), b as (select split, f, row_number() over (partition by split order by count(*) desc, f) k from i group by 1, 2)
 select t.split, total total_size, e.n expected_size, coalesce(total = e.n, true) size_match, a.l primary_language, round(a.n / total, 6) language_purity, b.f primary_format, round(v / total, 6) multimodal_ratio, subs subdomain_count, g has_images
 from t left join e on e.split = t.split join a on a.split = t.split and a.k = 1 join b on b.split = t.split and b.k = 1""")
def split_characteristics(spark, sf):
    """What each source is like; as many long texts as it has are expected of it."""
    docs = read(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    expected = docs.where("text is not null and length(text) > 100").groupBy("source").agg(F.count(F.lit(1)).alias("expected_size"))
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").contains("<img").alias("img"))
    rows = docs.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").join(pages, "doc_id", "left")
    rows = rows.select("source", F.col("lang").alias("language"), F.when(F.col("quality") == 1, "MCQ").when(F.col("quality") == 0, "Open").alias("format"), F.when(T.mentions_visual(F.col("text")), "Multimodal").alias("modality"), F.split(F.coalesce("text", F.lit("")), " ")[0].alias("label"), "img")
    return items.characteristics(rows, "source", expected, "label", F.col("img"))


@query("tagged_records", f"""with d as (select doc_id, lower(text) s, source from documents), t as (select doc_id, coalesce(source, '') source, {_words(taxonomy.CS_PARENTS)} tags from d)
 select doc_id, source native, array_to_string(case when len(tags) > 0 then tags else [source] end, ',') labels, case when len(tags) > 0 then array_to_string(tags, ',') end canonical from t""")
def tagged_records(spark, sf):
    """Extraction records whose labels (the source) give way to the parents that the text names; the first labels stay."""
    source = F.array(F.coalesce("source", F.lit("")))
    record = F.struct(source.alias("subdomains"), F.lit(None).cast("array<string>").alias("subdomains_native"))
    rows = read(spark, sf, "documents").select("doc_id", items.tag(record, taxonomy.parents(F.array("text"), taxonomy.CS_PARENTS)).alias("r"))
    return rows.select("doc_id", F.array_join("r.subdomains_native", ",").alias("native"), F.array_join("r.subdomains", ",").alias("labels"), F.array_join("r.subdomains_canonical", ",").alias("canonical"))


@query("sibling_labels", f"""with d as (select doc_id, lang, lower(text) s from documents), t as (select doc_id, lang, {_words(taxonomy.MATH_PARENTS)} tags from d),
 m as (select distinct unnest(tags) label from t where lang = 'en'), j as (select x.doc_id, y.tags from t x left join t y on y.doc_id = x.doc_id - 1 and y.lang = 'en' where x.lang <> 'en')
 select doc_id, array_to_string(list_transform(coalesce(tags, []), lambda v: upper(v)), ',') labels from j""")
def sibling_labels(spark, sf):
    """Items of other languages with the labels of the English item before them, in their own spelling."""
    docs = read(spark, sf, "documents")
    english = docs.where("lang = 'en'").select((F.col("doc_id") + 1).alias("id"), taxonomy.parents(F.array("text"), taxonomy.MATH_PARENTS).alias("labels"))
    mapping = english.select(F.explode("labels").alias("label")).distinct().withColumn("canonical", F.upper("label"))
    got = items.sibling_labels(docs.where("lang <> 'en'").select(F.col("doc_id").alias("id")), english, mapping)
    return got.select(F.col("id").alias("doc_id"), F.array_join("labels", ",").alias("labels"))


@query("parent_counts", f"with {QUESTIONS} select coalesce(nullif(super_parent, ''), 'unknown') super_parent, count(*) filter (design_type <> 'adversarial') standard, count(*) filter (design_type = 'adversarial') adversarial from v_questions group by 1")
def parent_counts(spark, sf):
    return items.count_by_parent(views.questions(spark, sf))


@query("answers_by_model_id", f"""with {ANSWERS}, n as (select *, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then answer_model end mid, upper(answer_model) || ' (' || coalesce(designer_model, '') || ')' nm from v_answers),
 k as (select coalesce(nullif(mid, ''), nullif(regexp_replace(regexp_replace(lower(nm), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')) model_id from n) select model_id, count(*) answers from k group by 1""")
def answers_by_model_id(spark, sf):
    """Answers by their model's identifier, or by the slug of its name where there is none."""
    rows = views.answers(spark, sf)
    given = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("answer_model"))
    name = F.concat(F.upper("answer_model"), F.lit(" ("), F.coalesce("designer_model", F.lit("")), F.lit(")"))
    return rows.groupBy(items.model_id(given, name).alias("model_id")).agg(F.count(F.lit(1)).alias("answers"))


@query("context_previews", """with t as (select conv_id, list(left(text, 20) order by turn, text) filter (text is not null) a, list(role || turn order by turn, role) filter (role is not null) b from conversations group by 1)
 select conv_id, array_to_string(coalesce(a, [])[1:3], '|') texts, array_to_string(coalesce(b, [])[1:2], '|') images from t""")
def context_previews(spark, sf):
    """The first texts and pictures of each conversation (here its roles)."""
    first = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x.v)
    turns = read(spark, sf, "conversations")
    # Only a conversation's first turns can be previewed.
    early = turns.withColumn("r", F.row_number().over(views.by("conv_id", "turn"))).where("r <= 8")
    rows = early.groupBy("conv_id").agg(first(F.when(F.col("text").isNotNull(), F.col("turn")).alias("t"), F.col("text").alias("o"), F.left("text", F.lit(20)).alias("v")).alias("texts"), first(F.col("turn").alias("t"), F.concat("role", F.col("turn").cast("string")).alias("v")).alias("images"))
    return items.preview(rows, "texts", "images").select("conv_id", F.array_join("texts", "|").alias("texts"), F.array_join("images", "|").alias("images"))


SHAPES = "case event_id % 4 when 0 then props when 1 then '[' || props || ', 1, \"x\", ' || props || ']' when 2 then 'null' else '[]' end"


@query("question_payloads", f"""with s as (select event_id, {SHAPES} j from events)
 select event_id, case json_type(j) when 'ARRAY' then json_array_length(j) when 'NULL' then 0 else 1 end listed, case json_type(j) when 'ARRAY' then len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'OBJECT')) else 0 end objects from s where j is not null""")
def question_payloads(spark, sf):
    """Payloads that are lists, objects or nothing, as lists, and their objects."""
    rows = read(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(SHAPES)).alias("v")).where("v is not null")
    return rows.select("event_id", F.size(items.as_list(F.col("v"))).cast("long").alias("listed"), F.size(items.objects(F.col("v"))).cast("long").alias("objects"))


@query("recommended_labels", "select source, array_to_string(list_sort(list_distinct(list_concat(list(lang) filter (lang is not null), list(regexp_extract(lower(text), '[a-z]+')) filter (text is not null and regexp_matches(lower(text), '[a-z]'))))), ',') recommended from documents group by 1")
def recommended_labels(spark, sf):
    """The union of two sets of labels of a source: its languages and the words that its texts begin with."""
    word = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    rows = read(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(word != "", word)).alias("b"))
    return rows.select("source", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("recommended"))
