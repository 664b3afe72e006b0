"""Queries over records: languages and terms, defaults, cleaning, tags, scoring variants, orders and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import arrays as A
from evalloom.functions import mathx as M
from evalloom.functions import text as T
from evalloom.operators import planning, responses, rules, stability, taxonomy, views, vocab, windows
from evalloom.operators.views import ANSWERS, QUESTIONS, read
from evalloom.plans.registry import query
from evalloom.plans.texts import RUNS, STOP, STOPS, TERMS, _runs
from evalloom.sources import converters as C


def _q(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _case(value: str, table: dict) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


COUNTS = ", ".join(f"len(list_filter(w, lambda x: x in ({_q(k)}))) {n.lower()}" for n, k in T.FUNCTION_WORDS.items())


@query("detect_language", f"""with a as (select doc_id, case when doc_id % 3 = 0 then lang end said, coalesce(text, '') s from documents), w as (select *, regexp_extract_all(lower(s), '[a-z]+') w from a), c as (select doc_id, said, s, {COUNTS} from w)
 select doc_id, coalesce(case when said like 'zh%' or said like 'ch%' then 'Chinese' when said like 'en%' then 'English' when said like 'fr%' then 'French' when said like 'de%' or said like 'ge%' then 'German' else said end,
  case when regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') then 'Chinese' end,
  case greatest(english, french, german, spanish) when 0 then 'English' when english then 'English' when french then 'French' when german then 'German' else 'Spanish' end) "language" from c""")
def detect_language(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.detect_language(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.col("text")).alias("language"))


KEYS = ["csbench_en", "WeMath", "MedXpertQA_text", "tomb_cn", "Other_Set"]


@query("canonical_dataset", f"""with k as (select doc_id, lower(([{_q(KEYS)}])[1 + doc_id % 5]) k from documents)
 select doc_id, case when k like 'csbench%' then 'csbench' when k like 'wemath%' then 'wemath' when k like 'medxpertqa%' then 'medxpertqa' when k like 'tomb%' then 'tombench' else k end dataset from k""")
def canonical_dataset(spark, sf):
    key = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", T.canonical_dataset(key).alias("dataset"))


@query("text_preview", """with h as (select doc_id, array_to_string(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n')[1:6], chr(10)) h from documents) select doc_id, md5(case when length(h) > 800 then left(h, 797) || '...' else h end) digest from h""")
def text_preview(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.first_lines(F.col("text"))).alias("digest"))


@query("option_line", "select conv_id, md5(string_agg(chr(64 + turn::int % 26 + 1) || ') ' || role, ' | ' order by turn)) options from conversations where text is not null group by 1")
def option_line(spark, sf):
    letter = F.chr(F.lit(65) + F.col("turn") % 26)
    one = F.struct("turn", letter.alias("letter"), F.col("role").alias("content"))
    rows = read(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("o"))
    return rows.select("conv_id", F.md5(T.flatten_options(F.col("o"))).alias("options"))


FORMS, GENERIC = {"the": "The", "en": "in"}, ["and", "les", "und", "los"]
PHRASES = "t as (select item_id, regexp_extract_all(text, '[A-Za-z]+') w from benchmark), p as (select item_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' of'), list_transform(range(1, len(w)), lambda i: w[i] || ' of ' || w[i + 1])) c from t)"


def _phrases(spark, sf):
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))
    at = lambda f: F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), f)).otherwise(F.array().cast("array<string>"))
    ends = at(lambda i: F.concat(F.element_at("w", i), F.lit(" of")))
    whole = at(lambda i: F.concat(F.element_at("w", i), F.lit(" of "), F.element_at("w", i + 1)))
    return read(spark, sf, "benchmark").select("item_id", w.alias("w")).select("item_id", F.concat("w", ends, whole).alias("c"))


@query("clean_terms_en", f"""with {PHRASES}, m as (select item_id, list_filter(list_transform(c, lambda x: case lower(x) when 'the' then 'The' when 'en' then 'in' else x end), lambda x: lower(x) not in ({_q(GENERIC)})) c from p),
 f as (select item_id, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) c from m)
 select item_id, md5(array_to_string(list_filter(c, lambda x: not ((lower(x) like '% of' or lower(x) like '% of the') and len(list_filter(c, lambda y: starts_with(lower(y), lower(x)) and trim(substr(y, length(x) + 1)) <> '')) > 0)), ',')) terms from f""")
def clean_terms_en(spark, sf):
    return _phrases(spark, sf).select("item_id", F.md5(F.array_join(T.clean_terms_en(F.col("c"), FORMS, GENERIC), ",")).alias("terms"))


@query("clean_terms_by_dataset", f"""with {PHRASES}, z as (select item_id, list_filter(c, lambda x: len(list_filter(c, lambda y: length(y) > length(x) and contains(y, x))) = 0) c from p),
 zd as (select item_id, list_filter(c, lambda x, i: list_position(c, x) = i) c from z), e as (select item_id, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) c from p),
 ed as (select item_id, list_filter(c, lambda x: not ((lower(x) like '% of' or lower(x) like '% of the') and len(list_filter(c, lambda y: starts_with(lower(y), lower(x)) and trim(substr(y, length(x) + 1)) <> '')) > 0)) c from e)
 select e.item_id, md5(array_to_string(case when e.item_id % 2 = 1 then zd.c else ed.c end, ',')) terms from ed e join zd on zd.item_id = e.item_id join ed on ed.item_id = e.item_id""")
def clean_terms_by_dataset(spark, sf):
    """The cleaning of English or Chinese lists, by the dataset's name."""
    name = F.when(F.col("item_id") % 2 == 1, "set_zh").otherwise("set_en")
    return _phrases(spark, sf).select("item_id", F.md5(F.array_join(T.clean_terms(name, F.col("c")), ",")).alias("terms"))


@query("term_form", f"""with {TERMS}, c as (select count(*) n from documents), x as (select term, df, n from f, c union all select term || ' domain', df, n from f, c union all select term || '!', df, n from f, c)
 select term, case when length(term) < 3 then 'too_short' when len(list_filter(string_split_regex(lower(term), '\\s+'), lambda t: t not in ({STOPS}))) = 0 then 'all_stopwords' when df < 3 then 'too_rare' when df > n * 0.40::double then 'too_common'
  when not regexp_matches(term, '^[a-zA-Z0-9\\s/()+*.-]+$') then 'invalid_charset' when list_last(string_split_regex(lower(term), '\\s+')) in ({_q(rules.PLACEHOLDERS)}) then 'placeholder_suffix' end reason from x""")
def term_form(spark, sf):
    docs = read(spark, sf, "documents")
    freq = vocab.frequencies(vocab.terms(docs, "doc_id", "text"), "doc_id").select("term", "df")
    shapes = freq.unionByName(freq.withColumn("term", F.concat("term", F.lit(" domain")))).unionByName(freq.withColumn("term", F.concat("term", F.lit("!"))))
    return shapes.select("term", rules.form_reason(F.col("term"), F.col("df"), F.lit(docs.count()), STOP).alias("reason"))


DENY, EXCEPT = ["the", "of", "und", "les", "ation"], ["les"]


@query("denied_terms", f"with {TERMS} select term from f where term in ({_q(DENY)}) and term not in ({_q(EXCEPT)})")
def denied_terms(spark, sf):
    freq = vocab.frequencies(vocab.terms(read(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return freq.where(rules.denied(F.col("term"), DENY, EXCEPT)).select("term")


@query("relabel_sources", """with l as (select doc_id, unnest([source, lang, source]) label from documents), g as (select doc_id, list_sort(list_distinct(list(case when label in (select distinct lang from documents) then upper(label) else label end) filter (where label is not null))) c from l group by 1)
 select doc_id, array_to_string(c, ',') labels from g""")
def relabel_sources(spark, sf):
    """Labels of documents replaced by their canonical form."""
    docs = read(spark, sf, "documents")
    mapping = docs.select(F.col("lang").alias("label")).distinct().select("label", F.upper("label").alias("canonical"))
    got = vocab.relabel(docs.select("doc_id", F.array("source", "lang", "source").alias("labels")), "doc_id", "labels", mapping)
    return got.select("doc_id", F.array_join("canonical_labels", ",").alias("labels"))


UP = {"the": "article", "la": "article", "der": "article", "of": "link", "and": "link", "und": "link"}


@query("hierarchical_runs", f"""with {RUNS}, u as (select id, list_distinct(list_transform(a, lambda t: coalesce({_case('t', UP)}, t))) x, list_distinct(list_transform(b, lambda t: coalesce({_case('t', UP)}, t))) y from r)
 select id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 1), 6) jaccard from u""")
def hierarchical_runs(spark, sf):
    parents = F.create_map(*(F.lit(x) for kv in UP.items() for x in kv))
    return _runs(spark, sf).select("id", F.round(stability.hierarchical(F.col("a"), F.col("b"), parents), 6).alias("jaccard"))


@query("run_agreement", f"with {RUNS} select id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 1), 6) jaccard from r")
def run_agreement(spark, sf):
    return stability.agreement(_runs(spark, sf))


@query("last_answer", f"with {ANSWERS} select question_id, answer_model, max(event_id) event_id from v_answers group by 1, 2")
def last_answer(spark, sf):
    """The last duplicate of an answer wins."""
    return windows.last_by(views.answers(spark, sf), ["question_id", "answer_model"], "event_id").select("question_id", "answer_model", "event_id")


@query("first_answer_fields", f"with {ANSWERS} select question_id, arg_min(designer_model, event_id) designer_model, arg_min(\"value\", event_id) \"value\" from v_answers group by 1")
def first_answer_fields(spark, sf):
    """The first record of a question supplies its item-level fields."""
    return windows.first_by(views.answers(spark, sf), ["question_id"], "event_id").select("question_id", "designer_model", "value")


@query("running_id", "select doc_id, lang, row_number() over (partition by lang order by doc_id) running_id from documents")
def running_id(spark, sf):
    return windows.running_id(read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("sample_per_source", "with r as (select doc_id, source, row_number() over (partition by source order by md5('42:' || doc_id::varchar), doc_id) k from documents) select doc_id, source from r where k <= 5")
def sample_per_source(spark, sf):
    return windows.sample_by(read(spark, sf, "documents").select("doc_id", "source"), ["source"], 5, 42, "doc_id")


@query("per_batch_counts", f"with {QUESTIONS} select super_parent || '_' || floor(generation_index / 20)::bigint custom_id, count(*) questions from v_questions group by 1")
def per_batch_counts(spark, sf):
    key = F.concat_ws("_", "super_parent", F.floor(F.col("generation_index") / 20).cast("string"))
    return views.questions(spark, sf).where("super_parent is not null").groupBy(key.alias("custom_id")).agg(F.count(F.lit(1)).alias("questions"))


@query("providers_by_designer", f"with {ANSWERS} select designer_model, string_agg(distinct answer_model, ',' order by answer_model) providers from v_answers group by 1")
def providers_by_designer(spark, sf):
    return views.answers(spark, sf).groupBy("designer_model").agg(F.array_join(F.array_sort(F.collect_set("answer_model")), ",").alias("providers"))


@query("label_order", f"with {TERMS} select term label, tf, row_number() over (order by tf desc, length(term), lower(term)) rank from f order by rank limit 200")
def label_order(spark, sf):
    """Labels by falling frequency, then length, then name; the first 200 are the report."""
    freq = vocab.frequencies(vocab.terms(read(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    top = freq.orderBy(F.desc("tf"), F.length("term"), F.lower("term")).limit(200)
    return windows.top_k(top.select(F.col("term").alias("label"), "tf", F.lit(0).alias("g")), ["g"], 200, F.desc("tf"), F.length("label"), F.lower("label")).drop("g")


@query("cluster_ranking", f"with {TERMS} select left(term, 2) canonical, sum(tf)::bigint total_freq, count(*) variants from f group by 1")
def cluster_ranking(spark, sf):
    freq = vocab.frequencies(vocab.terms(read(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return freq.groupBy(F.left("term", F.lit(2)).alias("canonical")).agg(F.sum("tf").alias("total_freq"), F.count(F.lit(1)).alias("variants")).orderBy(F.desc("total_freq"), "canonical")


STATUS = "s as (select *, ([ 'clean', 'suspect_static', 'broken_static', 'candidate'])[1 + event_id % 4] item_status, case when event_id % 7 = 0 then 'skip_core' else 'numeric_exact' end scoring_method from v_answers)"


def _status(spark, sf):
    names = F.array(*map(F.lit, ["clean", "suspect_static", "broken_static", "candidate"]))
    return views.answers(spark, sf).withColumns({"item_status": F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")), "scoring_method": F.when(F.col("event_id") % 7 == 0, "skip_core").otherwise("numeric_exact")})


@query("core_filter", f"with {ANSWERS}, {STATUS} select answer_model, count(*) core from s where item_status in ('clean', 'suspect_static') and scoring_method <> 'skip_core' group by 1")
def core_filter(spark, sf):
    return _status(spark, sf).where(responses.is_core()).groupBy("answer_model").agg(F.count(F.lit(1)).alias("core"))


@query("core_vs_skip", f"with {ANSWERS}, {STATUS} select designer_model \"key\", count(*) filter (where scoring_method <> 'skip_core') core, count(*) filter (where scoring_method = 'skip_core') skip from s group by 1")
def core_vs_skip(spark, sf):
    return responses.core_vs_skip(_status(spark, sf), F.col("designer_model"))


@query("clear_flag", f"with {QUESTIONS}, f as (select question_id, list_filter([case when quality = 0 then 'low_quality' end, case when n_chars % 2 = 0 then 'missing_answer' end], lambda x: x is not null) f from v_questions), l as (select question_id, list_filter(f, lambda x: x <> 'missing_answer') f from f) select question_id, array_to_string(f, ',') flags, case when len(f) = 0 then 'candidate' else 'flagged' end status from l")
def clear_flag(spark, sf):
    flags = F.filter(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("n_chars") % 2 == 0, "missing_answer")), lambda x: x.isNotNull())
    rows = views.questions(spark, sf).select("question_id", flags.alias("f"), F.lit("flagged").alias("s"))
    left, status = responses.clear_flag("f", "missing_answer", "s")
    return rows.select("question_id", F.array_join(left, ",").alias("flags"), status.alias("status"))


@query("question_defaults", """select doc_id id, case when doc_id % 5 = 0 then 'gpt' else coalesce(lang, 'gpt') end designer_model, 'set' source_dataset, case when doc_id % 4 = 1 then 'adversarial' else 'standard' end design_type,
 case when doc_id % 3 = 0 then 'structured' when doc_id % 3 = 1 then case when doc_id % 2 = 0 then 'mcq_single' else 'open_ended' end else 'mcq_multi' end question_type,
 case when doc_id % 3 = 2 or (doc_id % 3 = 1 and doc_id % 2 = 0) then case when doc_id % 2 = 0 then 2 else 0 end else 0 end n_options, false uses_visual from documents""")
def question_defaults(spark, sf):
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").select(
        i.alias("id"), F.when(i % 5 != 0, F.col("lang")).alias("designer_model"), F.when(i % 4 == 1, " Adversarial ").when(i % 4 == 2, "odd").when(i % 4 == 3, "").alias("design_type"),
        F.when(i % 3 == 0, "structured").when(i % 3 == 2, "mcq_multi").alias("question_type"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("options"), F.lit(None).cast("boolean").alias("uses_visual"),
    )
    return C.question_defaults(rows, "gpt", "set").select("id", "designer_model", "source_dataset", "design_type", "question_type", F.size("options").cast("long").alias("n_options"), "uses_visual")


@query("quality_fields", "select doc_id, case when doc_id % 2 = 0 then 'clean' else 'candidate' end item_status, case when doc_id % 3 = 0 then 'x' else '' end flags, case when doc_id % 3 = 0 then 'judge,static_rules' when doc_id % 3 = 1 then 'static_rules' else 'static_rules,judge' end sources from documents")
def quality_fields(spark, sf):
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").select("doc_id", F.when(i % 2 == 0, "clean").alias("item_status"), F.when(i % 3 == 0, F.array(F.lit("x"))).alias("item_quality_flags"), F.when(i % 3 == 0, F.array(F.lit("judge"))).when(i % 3 == 2, F.array(F.lit("static_rules"), F.lit("judge"))).alias("item_quality_source"))
    got = C.quality_fields(rows)
    return got.select("doc_id", "item_status", F.array_join("item_quality_flags", ",").alias("flags"), F.array_join("item_quality_source", ",").alias("sources"))


@query("item_style", "select doc_id, case when lang is null or lang = 'en' then 'English' when lang = 'zh' then 'Chinese' else lang end \"language\", 'Multiple-choice' format, case when doc_id % 2 = 0 then 'Multimodal' else 'Text' end modality from documents")
def item_style(spark, sf):
    s = C.style(F.col("lang"), F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "Multimodal"))
    return read(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("frozen_fallback", "select d.doc_id, coalesce(l.quality, -1)::bigint quality, coalesce(l.toxic, 0)::bigint toxic from documents d left join labels l on l.doc_id = d.doc_id")
def frozen_fallback(spark, sf):
    """Items with the results of an earlier run, and defaults where it has none."""
    frozen = read(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return read(spark, sf, "documents").select("doc_id").join(frozen, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))


NUM = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
NORM = lambda c: rf"regexp_replace(regexp_replace(replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '’', ''''), '\s+', ' ', 'g'), '[.!?]$', '')"
PAIR = f"""x as (select conv_id, turn, text gold, lead(text) over (partition by conv_id order by turn) nxt from conversations), y as (select conv_id, turn, gold, case turn % 4 when 0 then nxt when 1 then gold || '.' when 2 then gold || ' 7' else nxt end pred from x),
 n as (select *, {NORM('pred')} p, {NORM('gold')} g, try_cast(nullif(regexp_extract(pred, '{NUM}'), '') as double) np, try_cast(nullif(regexp_extract(gold, '{NUM}'), '') as double) ng from y),
 l as (select *, list_distinct(list_filter(string_split_regex(g, '[^a-zA-Z0-9_]+'), lambda w: length(w) > 3)) lw from n),
 o as (select *, case when regexp_matches(g, '^[\\s\\d\\.,eE+\\-*/^()]+$') and np is not null and ng is not null then abs(np - ng) <= greatest(1e-6::double, abs(ng) * 1e-4::double)
  when p = g or (p = 'ram' and g = 'random access memory') or (g = 'ram' and p = 'random access memory') or (p = 'os' and g = 'operating system') or (g = 'os' and p = 'operating system') then true
  else len(lw) >= 3 and len(list_filter(lw, lambda w: contains(p, w))) / len(lw) >= 0.6::double end open from l)"""


def _pairs(spark, sf):
    from pyspark.sql import Window

    t = F.col("turn")
    rows = read(spark, sf, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.col("text").alias("gold"), F.when(t % 4 == 1, F.concat("text", F.lit("."))).when(t % 4 == 2, F.concat("text", F.lit(" 7"))).otherwise(F.col("nxt")).alias("pred"))


@query("open_ended_scores", f"with {PAIR} select conv_id, turn, open ok from o where pred is not null and gold is not null")
def open_ended_scores(spark, sf):
    return _pairs(spark, sf).where("pred is not null and gold is not null").select("conv_id", "turn", M.score_open_ended(F.col("pred"), F.col("gold")).alias("ok"))


@query("legacy_scores", f"""with {PAIR} select conv_id, turn, case when gold is null or pred is null then case when turn % 5 = 4 then null else false end when turn % 5 = 0 then upper(pred) = upper(gold)
 when turn % 5 = 1 then list_sort(list_distinct(regexp_extract_all(upper(pred), '[A-H]'))) = list_sort(list_distinct(regexp_extract_all(upper(gold), '[A-H]')))
 when turn % 5 = 2 then coalesce(abs(np - ng) <= greatest(1e-6::double, abs(ng) * 1e-4::double), false) when turn % 5 = 4 then null when turn % 2 = 1 then open else p = g end ok from o""")
def legacy_scores(spark, sf):
    t = F.col("turn")
    kind = F.when(t % 5 == 0, "mcq_single").when(t % 5 == 1, "mcq_multi").when(t % 5 == 3, F.when(t % 2 == 1, "open_ended").otherwise("cloze")).otherwise("structured")
    method = F.when(t % 5 == 2, "numeric").when(t % 5 == 4, "judge").otherwise("exact")
    return _pairs(spark, sf).select("conv_id", "turn", M.legacy_score(kind, method, F.col("gold"), F.col("pred")).alias("ok"))


TYPES = [*M.TOKEN_BUDGET, "unheard_of"]


@query("token_budget", f"with t as (select doc_id, ([{_q(TYPES)}])[1 + doc_id % {len(TYPES)}] question_type from documents) select doc_id, question_type, coalesce({_case('question_type', M.TOKEN_BUDGET)}::int, 1024) budget from t")
def token_budget(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", kind.alias("question_type")).withColumn("budget", M.token_budget(F.col("question_type")))


@query("cosine_neighbours", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf):
    e = read(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", "embedding").join(nxt, "vec_id").select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("text_forms", r"""select conv_id, turn, md5(translate(regexp_replace(lower(text), '\s+', '', 'g'), '×·', '**')) math, regexp_replace(role || ' / ' || conv_id, '[^\p{L}\p{N}_-]', '_', 'g') safe, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) svg,
 length(left(text, 50000)) prompt, regexp_matches(text, '(?i)\b(image|diagram|figure|picture|graph|chart|photo|draw|visual)\b') visual, regexp_replace('A. ' || text, '^\s*\(?A[.:)、]\s*', '') = text as stripped from conversations""")
def text_forms(spark, sf):
    t = F.col("text")
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(T.normalize_math(t)).alias("math"), T.safe_name(F.concat("role", F.lit(" / "), "conv_id")).alias("safe"), F.md5(T.svg_escape(t)).alias("svg"),
        F.length(T.prompt_text(t)).cast("long").alias("prompt"), T.mentions_visual(t).alias("visual"), (T.strip_option(F.concat(F.lit("A. "), t), F.lit("A")) == t).alias("stripped"),
    )


@query("language_forms", "select doc_id, case when lang = 'en' then 'english' when lang = 'zh' then 'chinese' else lower(lang) end low, case when lang = 'english' then 'en' when lang in ('chinese', 'cn') then 'zh' else lower(lang) end code from documents")
def language_forms(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.language_lower(F.col("lang")).alias("low"), T.language_code(F.col("lang")).alias("code"))


VISUAL = "v as (select question_id, answer_model, is_correct, regexp_matches(stem, '(?i)\\b(image|diagram|figure|picture|graph|chart|photo|draw|visual)\\b') mention, (['text_only', 'visual_optional', 'visual_required'])[1 + question_id % 3] cond from v_answers join v_questions using (question_id) where is_correct is not null)"


@query("visual_accuracy", f"with {ANSWERS}, {QUESTIONS}, {VISUAL} select mention, cond, count(*) n, round(avg(is_correct::int), 6) accuracy, grouping(mention, cond)::bigint level from v group by grouping sets ((mention), (cond), (cond, mention))")
def visual_accuracy(spark, sf):
    """Accuracy by mention of a visual, by visual condition, and by both."""
    stems = views.questions(spark, sf).select("question_id", T.mentions_visual(F.col("stem")).alias("mention"))
    conds = F.element_at(F.array(*map(F.lit, ["text_only", "visual_optional", "visual_required"])), (F.col("question_id") % 3 + 1).cast("int"))
    rows = views.answers(spark, sf).where("is_correct is not null").join(stems, "question_id").withColumn("cond", conds)
    m, c = F.col("mention"), F.col("cond")
    return rows.groupingSets([[m], [c], [c, m]], m, c).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"), F.grouping_id("mention", "cond").cast("long").alias("level"))


SPECIAL = [a for table in (taxonomy.SPECIALTIES, taxonomy.TASK_AXES) for names in table.values() for a in names]


def _first(table: dict) -> str:
    return "case " + " ".join(f"when regexp_matches(v, '(^|[^a-z])({'|'.join(a)})($|[^a-z])') then '{c}'" for c, a in table.items()) + " else '' end"


@query("specialty_tags", f"with v as (select doc_id, lower('Advanced ' || ([{_q(SPECIAL)}])[1 + doc_id % {len(SPECIAL)}] || ' topics') v from documents) select doc_id, {_first(taxonomy.SPECIALTIES)} specialty, {_first(taxonomy.TASK_AXES)} axis from v")
def specialty_tags(spark, sf):
    label = F.concat(F.lit("Advanced "), F.element_at(F.array(*map(F.lit, SPECIAL)), (F.col("doc_id") % len(SPECIAL) + 1).cast("int")), F.lit(" topics"))
    return read(spark, sf, "documents").select("doc_id", taxonomy.first_category(label, taxonomy.SPECIALTIES).alias("specialty"), taxonomy.first_category(label, taxonomy.TASK_AXES).alias("axis"))


SCENES = {"Imaging": ["radiology", "imaging"], "Surgery": ["surgical", "orthopedic"], "Heart": ["cardi"], "Child": ["pediatric"]}
MAPPED = {"radiology": "Imaging", "cardiology": "Heart", "pathology": "Lab", "neuro": "Nerves"}


@query("scenario_tags", f"""with v as (select doc_id, ([{_q(SPECIAL)}])[1 + doc_id % {len(SPECIAL)}] a, ([{_q(SPECIAL)}])[1 + (doc_id * 7 + 3) % {len(SPECIAL)}] b from documents), s as (select doc_id, lower(a || ' ' || b) s from v)
 select doc_id, array_to_string(list_filter([{", ".join("case when " + " or ".join(f"contains(s, '{k}')" for k in keys) + f" then '{c}' end" for c, keys in SCENES.items())}], lambda x: x is not null)[1:3], ',') scenarios from s""")
def scenario_tags(spark, sf):
    at = lambda i: F.element_at(F.array(*map(F.lit, SPECIAL)), (i % len(SPECIAL) + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(taxonomy.scenarios(F.array(at(F.col("doc_id")), at(F.col("doc_id") * 7 + 3)), SCENES), ",").alias("scenarios"))


@query("enforced_labels", f"""with v as (select doc_id, case when doc_id % 3 = 0 then string_split_regex(([{_q(SPECIAL)}])[1 + doc_id % {len(SPECIAL)}] || ', radiology/neuro', '[,;/、，；]') else [] end n, 'On ' || ([{_q(SPECIAL)}])[1 + (doc_id * 5) % {len(SPECIAL)}] t, case when doc_id % 2 = 0 then ['Sibling'] end f from documents),
 m as (select doc_id, list_filter(list_transform(n, lambda x: {_case('trim(x)', MAPPED)}), lambda x: x is not null) one, list_filter([{", ".join(f"case when contains(t, '{k}') then '{v}' end" for k, v in MAPPED.items())}], lambda x: x is not null) two, coalesce(f, []) f from v),
 g as (select doc_id, case when len(one) > 0 then one when len(two) > 0 then two else f end g from m) select doc_id, array_to_string(list_sort(list_filter(g, lambda x, i: list_position(g, x) = i)[1:3]), ',') labels from g""")
def enforced_labels(spark, sf):
    at = lambda i: F.element_at(F.array(*map(F.lit, SPECIAL)), (i % len(SPECIAL) + 1).cast("int"))
    i = F.col("doc_id")
    native = F.when(i % 3 == 0, F.array(F.concat(at(i), F.lit(", radiology/neuro")))).otherwise(F.array().cast("array<string>"))
    got = taxonomy.enforce_labels(native, F.concat(F.lit("On "), at(i * 5)), F.when(i % 2 == 0, F.array(F.lit("Sibling"))), MAPPED)
    return read(spark, sf, "documents").select("doc_id", F.array_join(got, ",").alias("labels"))


@query("topup_requests", f"""with {QUESTIONS}, c as (select super_parent, design_type, count(*) actual from v_questions group by 1, 2), q as (select distinct source super_parent, design_type, case when design_type = 'standard' then 450 else 50 end quota from documents, (values ('standard'), ('adversarial')) v(design_type)),
 d as (select q.super_parent, q.design_type, greatest(0, quota - coalesce(actual, 0))::bigint deficit from q left join c on c.super_parent = q.super_parent and c.design_type = q.design_type)
 select super_parent, design_type, deficit, row_number() over (order by case when design_type = 'adversarial' then 0 else 1 end, deficit desc, super_parent) place from d where deficit > 0""")
def topup_requests(spark, sf):
    """Requests in the order in which they are asked for; as many as there are quotas."""
    both = F.array(F.struct(F.lit("standard").alias("design_type"), F.lit(450).alias("quota")), F.struct(F.lit("adversarial").alias("design_type"), F.lit(50).alias("quota")))
    quotas = read(spark, sf, "documents").select(F.col("source").alias("super_parent")).distinct().select("super_parent", F.inline(both))
    actual = views.questions(spark, sf).groupBy("super_parent", "design_type").agg(F.count(F.lit(1)).alias("actual"))
    asked = planning.topup_requests(planning.deficits(quotas, actual, ["super_parent", "design_type"]))
    return windows.top_k(asked.select("super_parent", "design_type", "deficit", F.lit(0).alias("g")), ["g"], 1 << 30, F.when(F.col("design_type") == "adversarial", 0).otherwise(1), F.desc("deficit"), "super_parent").drop("g").withColumnRenamed("rank", "place")


@query("full_item_issues", """with i as (select doc_id, doc_id % 3 opts, doc_id % 4 ans, doc_id % 2 = 0 multi, doc_id % 5 pics, doc_id % 7 <> 0 mcq from documents)
 select doc_id item_id, unnest(list_filter([case when ans in (0, 1) then 'empty_answer' end, case when mcq and opts < 2 then 'few_options' end, case when multi and pics = 0 then 'missing_image' end], lambda x: x is not null)) category from i""")
def full_item_issues(spark, sf):
    i = F.col("doc_id")
    some = lambda n: F.slice(F.array(*map(F.lit, "abcde")), F.lit(1), n.cast("int"))
    rows = read(spark, sf, "documents").select(
        "doc_id", some(i % 3).alias("options"), F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("A"))).alias("answer"),
        some(i % 5).alias("images"), F.when(i % 2 == 0, "Multimodal").otherwise("Text").alias("modality"), F.when(i % 7 != 0, "MCQ").otherwise("Open").alias("format"),
    )
    return rules.issues(rows, "doc_id", rules.full_item_rules()).select("item_id", "category")


@query("merged_lists", "with a as (select doc_id, [source, lang] x, case when doc_id % 2 = 0 then [lang, 'z', source] end y from documents), c as (select doc_id, list_filter(list_concat(x, coalesce(y, [])), lambda v: v is not null) c from a) select doc_id, array_to_string(list_filter(c, lambda v, i: list_position(c, v) = i), ',') merged from c")
def merged_lists(spark, sf):
    both = A.merge(F.array("source", "lang"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.lit("z"), "source")))
    return read(spark, sf, "documents").select("doc_id", F.array_join(both, ",").alias("merged"))


@query("question_records", """select doc_id, case when doc_id % 2 = 0 then doc_id::varchar else 'q_' || lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') end question_id, case when doc_id % 3 = 0 then n_chars::varchar when doc_id % 3 = 1 then lang else 'A,B' end gold_answer,
 case when doc_id % 3 = 0 then 'numeric' when doc_id % 3 = 1 then 'single' else 'multi' end answer_type, case when doc_id % 4 = 0 then 'visual_required' when doc_id % 4 = 1 then 'visual_optional' else 'text_only' end visual_condition from documents where lang is not null""")
def question_records(spark, sf):
    i = F.col("doc_id")
    rows = read(spark, sf, "documents").where("lang is not null").select(
        "doc_id", F.when(i % 2 == 0, i.cast("string")).otherwise("").alias("id"), F.when(i % 3 == 0, F.col("n_chars").cast("string")).when(i % 3 == 1, F.col("lang")).otherwise("").alias("answer_text"),
        F.when(i % 3 == 2, F.array(F.lit("A"), F.lit("B"))).alias("answer_set"), F.when(i % 3 == 1, "mcq_single").when(i % 3 == 2, "mcq_multi").otherwise("open_ended").alias("question_type"),
        F.when(i % 4 == 0, "Image required").when(i % 4 == 1, "Multimodal").otherwise("Text").alias("modality"), i.cast("int").alias("place"),
    )
    got = C.question_record(rows, "place")
    return got.select("doc_id", "question_id", "gold_answer", "answer_type", "visual_condition")


@query("item_projections", """select doc_id, md5(concat_ws(' ', nullif(coalesce(text, ''), ''), case when length(source) > 10 then source else '' end)) short, case when doc_id % 2 = 0 then null else source end pictures, greatest(doc_id % 3, doc_id % 2) + 1 images from documents""")
def item_projections(spark, sf):
    """The whitelisted text of an item, image fields of text-only items, and images of several places."""
    i = F.col("doc_id")
    names = lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.lit("i"), k.cast("string")))
    rows = read(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("question"), F.create_map(F.lit("source"), F.coalesce("source", F.lit(""))).alias("background"), F.struct(F.lit(None).cast("string").alias("story")).alias("context"),
        F.when(i % 2 == 0, "Text").otherwise("Multimodal").alias("modality"), F.col("source").alias("pictures"), C.all_images(names(i % 3), names(i % 2), F.lit(None).cast("array<string>")).alias("many"),
    )
    clean = C.without_images(rows, "pictures")
    return clean.select("doc_id", F.md5(C.item_text_short()).alias("short"), "pictures", F.size("many").cast("long").alias("images"))
