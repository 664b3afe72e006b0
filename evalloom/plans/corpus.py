"""Queries over a corpus's vocabulary, concept categories, dataset names, item contexts and answer records."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import context, lexicon, responses, rules, vocab
from evalloom.operators.views import read
from evalloom.plans.registry import query


def _q(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _list(items) -> str:
    return f"[{_q(items)}]"


def _pick(items, i):
    return F.element_at(F.array(*map(F.lit, items)), (i % len(items) + 1).cast("int"))


def _form(x: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(trim({x})), '[_-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s()+/*-]', '', 'g')"
    return f"trim(regexp_replace(case when length({t}) > 3 and {t} like '%s' and {t} not like '%ss' then left({t}, length({t}) - 1) else {t} end, '\\s+', ' ', 'g'))"


def _form_zh(x: str) -> str:
    out = f"translate(trim({x}), ' ' || chr(12288), '')"
    for old, new in vocab.HAN_FORMS.items():
        out = f"replace({out}, '{old}', '{new}')"
    return f"regexp_replace(translate({out}, '（）', '()'), '[^\\x{{4e00}}-\\x{{9fff}}0-9()\\-、]', '', 'g')"


WORDS = f"""w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') w from documents), g as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) x from w),
 u as (select x, {_form('x')} term from (select distinct x from g)), k as (select doc_id, x, count(*) n from g group by 1, 2), f as (select term, sum(n)::bigint tf, count(distinct doc_id)::bigint df from k join u on u.x = k.x where term <> '' group by 1), c as (select count(*) n from documents)"""


@query("corpus_frequencies", f"with {WORDS} select term, tf, df from f")
def corpus_frequencies(spark, sf):
    """Words and pairs of words of all documents in their vocabulary form."""
    return vocab.corpus_frequencies(read(spark, sf, "documents"), "text")


def _barred(language: str, domain: str) -> str:
    stop = _q(lexicon.stopwords(language, domain))
    deny, fine = _q(lexicon.denylist(language, domain)), _q(lexicon.allowed(language, domain) or [""])
    return f"""length(term) < 3 or len(list_filter(string_split(term, ' '), lambda t: t not in ({stop}))) = 0 or df < 3 or df > n * 0.40::double or not regexp_matches(term, '^[a-zA-Z0-9\\s/()+*.-]+$')
  or list_last(string_split(term, ' ')) in ({_q(rules.PLACEHOLDERS)}) or (term in ({deny}) and term not in ({fine}))"""


SEEDS = sorted({x for k in ("mental_states", "emotions", "social_acts") for x in lexicon.CONCEPTS[k]})


@query("corpus_enum", f"""with {WORDS}, m as (select {_form("coalesce(source, '') || ' items'")} term, count(*) n from documents group by 1), a as (select coalesce(f.term, m.term) term, coalesce(tf, 0) + coalesce(m.n, 0) tf, coalesce(df, 0) df from f full join m on m.term = f.term),
 e as (select term, tf from a, c where tf >= 3 and not ({_barred('en', 'psychology')}) order by tf desc, term limit 400), s as (select unnest({_list(SEEDS)}) x, unnest(range({len(SEEDS)})) i)
 select 'term_' || lpad((row_number() over (order by tf desc, term) - 1)::varchar, 4, '0') id, term "name", term aliases, tf::bigint frequency from e
 union all select 'tiny_tom_' || lpad(i::varchar, 3, '0'), {_form('x')}, array_to_string(list_sort(list_distinct([x, {_form('x')}])), ','), 1000 - i from s""")
def corpus_enum(spark, sf):
    """The vocabulary of all documents and of labels a model gave them; the 400 entries are the vocabulary's size."""
    docs = read(spark, sf, "documents")
    labels = docs.select(F.concat(F.coalesce("source", F.lit("")), F.lit(" items")).alias("term"))
    enum = vocab.corpus_enum(vocab.corpus_frequencies(docs, "text"), docs.count(), "en", "psychology", labels)
    return enum.withColumn("aliases", F.array_join("aliases", ","))


LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "系统数据存储信息程序主内缓文件操作栈队列树图排查找算"


@query("corpus_enum_zh", f"""with t as (select item_id, {_form_zh(f"translate(lower(coalesce(text, '')), '{LATIN}', '{HAN}')")} t from benchmark), r as (select item_id, unnest(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]+')) r from t),
 g as (select item_id, unnest(flatten(list_transform(range(2, 7), lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))))) x from r), h as (select item_id, {_form_zh('x')} term from g),
 f as (select term, count(*) tf, count(distinct item_id) df from h where term <> '' group by 1), c as (select count(*) n from benchmark),
 e as (select term, tf from f, c where tf >= 3 and df >= 2 and df <= n * 0.40::double and length(term) between 2 and 12 and term not in ({_q(lexicon.stopwords('zh', 'cs'))}) and not (term in ({_q(lexicon.denylist('zh', 'cs'))}) and term not in ({_q(lexicon.allowed('zh', 'cs'))})) order by tf desc, term limit 400)
 select 'term_' || lpad((row_number() over (order by tf desc, term) - 1)::varchar, 4, '0') id, term "name", term aliases, tf frequency from e""")
def corpus_enum_zh(spark, sf):
    """The vocabulary of Han windows; each letter of the items stands for a Han character."""
    items = read(spark, sf, "benchmark").select(F.translate(F.lower("text"), LATIN, HAN).alias("text"))
    enum = vocab.corpus_enum(vocab.corpus_frequencies(items, "text", "zh"), items.count(), "zh", "cs")
    return enum.withColumn("aliases", F.array_join("aliases", ","))


@query("vocabulary_seeds", "with z(i, x, a) as (values " + ", ".join(f"({i}, '{x}', {_list(a)})" for i, (x, a) in enumerate(lexicon.SEEDS_ZH)) + """), s as (select 'tiny_tom_zh_' || lpad(i::varchar, 3, '0') id, x "name", list_sort(list_distinct(list_append(a, x))) l, (1000 - i)::bigint frequency from z),
 d as (select text from documents union all select text from benchmark), n as (select id, count(*) held from s, d where len(list_filter(l, lambda v: contains(d.text, v))) > 0 group by 1)
 select s.id, "name", array_to_string(l, ',') aliases, frequency, coalesce(held, 0) held from s left join n on n.id = s.id""")
def vocabulary_seeds(spark, sf):
    """The fixed seeds, with the number of documents and test items that hold a seed or one of its aliases."""
    seeds = vocab.seeds(spark, "zh")
    names = seeds.collect()  # the fixed list
    texts = read(spark, sf, "documents").select("text").unionByName(read(spark, sf, "benchmark").select("text"))
    holds = F.array(*(F.when(F.exists(F.array(*map(F.lit, r.aliases)), lambda a: F.col("text").contains(a)), F.lit(r.id)) for r in names))
    held = texts.where("text is not null").select(F.explode(F.array_compact(holds)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    return seeds.join(held, "id", "left").select("id", "name", F.array_join("aliases", ",").alias("aliases"), "frequency", F.coalesce("held", F.lit(0).cast("long")).alias("held"))


# Terms of each category, and of none.
TERMS = ["False belief", "joy", "lie", "they think so", "a happy-dog", "Birthday Party", "gift", "Xiao Ming", "小明", "欧阳修文学", "信念", "想法的", "开心", "计划", "在哪里", "公园", "  ", "network", "secret plan", "lao wang"]


def _category(x: str) -> str:
    low = f"lower(trim({x}))"
    among = lambda name: f"{low} in ({_q(lexicon.CONCEPTS[name])})"
    has = lambda name: f"len(list_filter(string_split_regex({low}, '[\\s\\-_/]+'), lambda t: t in ({_q(lexicon.CONCEPTS[name])}))) > 0"
    return f"""case when {among('mental_states')} then 'mental_state' when {among('emotions')} then 'emotion' when {among('social_acts')} then 'social_act' when {has('mental_verbs')} then 'mental_state' when {has('emotion_words')} then 'emotion'
  when {among('context_places')} or {among('context_objects')} then 'context_place' when {low} like 'xiao %' or {low} like 'little %' or {low} like 'lao %' then 'context_name' when regexp_full_match({x}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,4}}') then 'context_name' else 'other' end"""


@query("concept_categories", f"""with t as (select doc_id, ({_list(TERMS)})[1 + doc_id % {len(TERMS)}] || case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '-' || coalesce(lang, '') else '了' end term from documents), c as (select doc_id, term, {_category('term')} category from t)
 select *, case category when 'mental_state' then 'belief' when 'emotion' then 'emotion' when 'social_act' then 'social' when 'context_place' then 'context' when 'context_name' then 'context' else 'other' end family from c""")
def concept_categories(spark, sf):
    i = F.col("doc_id")
    end = F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("-"), F.coalesce("lang", F.lit("")))).otherwise("了")
    rows = read(spark, sf, "documents").select("doc_id", F.concat(_pick(TERMS, i), end).alias("term"))
    return rows.withColumn("category", lexicon.concept_category(F.col("term"))).withColumn("family", lexicon.collapsed(F.col("category")))


def _safe(x: str) -> str:
    return f"({_category(x)}) in ('mental_state', 'emotion')"


@query("clean_concept_terms", f"""with t as (select doc_id, list_transform(range(6), lambda k: ({_list(TERMS)})[1 + (doc_id * (k + 1) + k) % {len(TERMS)}] || case when (doc_id + k) % 4 = 0 then '的' when (doc_id + k) % 4 = 1 then 's' else '' end) w from documents),
 s as (select doc_id, list_transform(list_filter(list_transform(w, lambda x: trim(x)), lambda x: x <> ''), lambda x: case when length(x) > 1 and right(x, 1) in ({_q(lexicon.PARTICLES)}) then left(x, length(x) - 1) else x end) w from t),
 p as (select doc_id, list_filter(w, lambda x: not ({' or '.join(f"contains(x, '{f}')" for f in lexicon.PLACE_FRAGMENTS)}) or {_safe('x')}) w from s), k as (select doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) w from p)
 select doc_id, array_to_string(list_filter(w, lambda x: {_safe('x')} or len(list_filter(w, lambda y: length(y) > length(x) and contains(y, x))) = 0), ',') terms from k""")
def clean_concept_terms(spark, sf):
    i = F.col("doc_id")

    def term(k: int):
        end = F.when((i + k) % 4 == 0, "的").when((i + k) % 4 == 1, "s").otherwise("")
        return F.concat(_pick(TERMS, i * (k + 1) + k), end)

    rows = read(spark, sf, "documents").select("doc_id", F.array(*(term(k) for k in range(6))).alias("w"))
    return rows.select("doc_id", F.array_join(lexicon.clean_concept_terms(F.col("w")), ",").alias("terms"))


NAMES = ["medxpertqa_mm_stage2_textonly", "wemath", "csbench_CN", "csbench_cn", "tombench_fr", "ESG_de", "anti_zh", "we_math_2", "wemath_stage2_visualprimed", "other"]


@query("dataset_traits", f"""with d as (select doc_id, ({_list(NAMES)})[1 + doc_id % {len(NAMES)}] s from documents), v(k, base, lang_, modality, suffix) as (values {', '.join(f"('{k}', '{v['base']}', '{v['language']}', '{v['modality']}', '{v['suffix']}')" for k, v in lexicon.VARIANTS.items())})
 select doc_id, {"".join(f"case when contains(lower(s), '{k}') then '{v}' else " for k, v in lexicon.DOMAINS.items())}'general' {"end " * len(lexicon.DOMAINS)} "domain",
  case when contains(lower(s), '_cn') then 'zh' when contains(lower(s), '_fr') then 'fr' when contains(lower(s), '_de') then 'de' else 'en' end "language", contains(s, 'cn') or contains(s, 'tombench') multilingual, coalesce(base, s) base,
  coalesce(lang_, case when contains(s, '_cn') or s like '%\\_zh' escape '\\' or s = 'wemath' then 'zh' when contains(s, '_fr') then 'fr' when contains(s, '_de') then 'de' else 'en' end) prompt_language,
  coalesce(v.modality, case when doc_id % 2 = 0 then 'multimodal' when doc_id % 3 = 0 then 'text+existing_image' else 'text' end) modality, 'Card' || coalesce(' (' || suffix || ')', '') display from d left join v on v.k = s""")
def dataset_traits(spark, sf):
    i = F.col("doc_id")
    name = F.col("s")
    rows = read(spark, sf, "documents").select("doc_id", _pick(NAMES, i).alias("s"))
    return rows.select(
        "doc_id", lexicon.dataset_domain(name).alias("domain"), lexicon.dataset_language(name).alias("language"), lexicon.is_multilingual(name).alias("multilingual"), lexicon.base_dataset(name).alias("base"),
        lexicon.prompt_language(name).alias("prompt_language"), lexicon.modality(name, i % 2 == 0, F.lit(True), i % 3 == 0).alias("modality"), lexicon.display_name(F.lit("Card"), name).alias("display"),
    )


SOURCES = ["csbench_en", "WeMath", "MedXpertQA_text", "tomb_cn", "Other_Set"]
TAGGED = context.SCHEMA | {"csbench": context.SCHEMA["csbench"] | {"tag_fields": ["Domain", "Tag"]}}


@query("context_packs", f"""with d as (select doc_id, doc_id % 5 k, coalesce(lang, '') lang, source, text from documents) select doc_id, case when k = 3 and regexp_matches(coalesce(text, ''), '\\S') then md5(text) else '' end "text",
  case k when 1 then '/data/data/raw_data/wemath/2steps/image/' || doc_id || '.png,/data/data/raw_data/wemath/3steps/image/' || doc_id || '.png,loose/./x.png,/' || doc_id || '.png,2steps' when 2 then '/data/data/raw_data/medxpertqa/images/' || doc_id || '.jpg,/abs/b.jpg' else '' end images,
  case when k = 0 then array_to_string(list_filter([source, lang, 'x'], lambda x: x <> ''), ',') else '' end tags from d""")
def context_packs(spark, sf):
    i = F.col("doc_id")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    no = i.cast("string")
    paths = F.array(cat("2steps/image/", no, ".png"), cat("3steps\\image\\", F.coalesce("lang", F.lit("xx")), "/z/../../", no, ".png"), F.lit(""), F.lit("loose/./x.png"), cat("2steps/image//", no, ".png"))
    named = lambda p: F.struct(p.alias("image_path"))
    objects = F.array(named(cat("a/../", no, ".jpg")), named(F.lit("/abs/./b.jpg")), named(F.lit(None).cast("string")), named(cat(no, ".jpg")))
    background = {"Domain": F.array("source"), "Tag": F.array(F.col("lang"), F.lit("x")), "image_path": F.array(F.lit("2steps"))}
    rows = read(spark, sf, "documents").select("doc_id", context.context_pack(_pick(SOURCES, i), {"story": F.array("text")}, background, paths, objects, "/data", TAGGED).alias("c"))
    digest = F.when(F.size("c.text") > 0, F.md5(F.array_join("c.text", "\n"))).otherwise("")
    return rows.select("doc_id", digest.alias("text"), F.array_join("c.images", ",").alias("images"), F.array_join("c.tags", ",").alias("tags"))


@query("answer_records", """with e as (select event_id, event_id % 4 k, user_id, event_type, value from events) select coalesce(case when k = 1 then event_type end, 'set') dataset, case when k = 2 then 'd' || user_id else 'designer' end designer_model, 'answerer' answer_model, 'q' || event_id question_id, event_type question_type,
  coalesce(case when k <> 3 then 'g' || user_id end, 'a') gold_answer, case when k = 0 then coalesce(case when value > 20 then value > 60 end, false) else case when value > 20 then value > 60 end end is_correct,
  case when event_type = 'click' then null when k = 0 then case when coalesce(case when value > 20 then value > 60 end, false) then 1.0 else 0.0 end::double else case when value > 60 then 1.0 when value > 20 then 0.0 end::double end soft_score, (512 + k)::int max_new_tokens from e""")
def answer_records(spark, sf):
    k = F.col("event_id") % 4
    rows = read(spark, sf, "events").select(
        F.when(k == 1, F.col("event_type")).otherwise("").alias("dataset"), F.when(k == 2, F.concat(F.lit("d"), F.col("user_id").cast("string"))).alias("designer_model"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("question_type"), F.when(k != 3, F.concat(F.lit("g"), F.col("user_id").cast("string"))).alias("gold_answer"), F.lit("a").alias("answer"), F.when(F.col("value") > 20, F.col("value") > 60).alias("is_correct"),
        F.when(k == 0, "timeout").alias("call_error"), F.when(F.col("event_type") == "click", "skip_core").otherwise("mcq_exact").alias("scoring_method"), (k + 512).cast("int").alias("max_tokens"),
    )
    got = responses.answer_record(rows, "set", {"key": "d1", "model": "designer"}, {"key": "a1", "name": "answerer", "temperature": 0.0, "top_p": 1.0})
    return got.select("dataset", "designer_model", "answer_model", "question_id", "question_type", "gold_answer", "is_correct", "soft_score", F.col("model_parameters.max_new_tokens").alias("max_new_tokens"))


def sized_oracle(prompts: list[str], tokens: list[int]) -> list:
    """Stands for a model: a prompt names the tokens it needs, and how the model fails with fewer."""

    def one(p: str, most: int):
        kind, need = p.split()
        if kind == "refuse":
            return RuntimeError("refused")
        return "ok" if most >= int(need) else RuntimeError("max_tokens") if kind == "raise" else ""

    return [one(p, t) for p, t in zip(prompts, tokens, strict=True)]


@query("reanswer", """with d as (select doc_id, case when coalesce(n_chars, 0) % 7 = 0 then 'refuse' when coalesce(n_chars, 0) % 2 = 1 then 'raise' else 'blank' end kind, coalesce(n_chars, 0) * 2 need, case when doc_id % 2 = 0 then 1024 else 4096 end b from documents),
 k as (select *, case when kind = 'refuse' then 1 when b >= need then 1 when least(2 * b, 8192) >= need then 2 when least(4 * b, 8192) >= need then 3 end used from d)
 select doc_id, case when kind = 'refuse' then null when used is not null then 'ok' when kind = 'blank' then '' end raw_output, coalesce(used, case when kind = 'blank' and b = 4096 then 2 else 3 end)::int calls,
  case when kind = 'refuse' then b when used is not null then least(b * (1 << (used - 1)), 8192) else 8192 end::int max_tokens, case when kind = 'refuse' then 'refused' when used is null and kind = 'raise' then 'max_tokens' end call_error from k""")
def reanswer(spark, sf):
    n = F.coalesce("n_chars", F.lit(0))
    kind = F.when(n % 7 == 0, "refuse").when(n % 2 == 1, "raise").otherwise("blank")
    rows = read(spark, sf, "documents").select("doc_id", F.concat(kind, F.lit(" "), (n * 2).cast("string")).alias("prompt"), F.when(F.col("doc_id") % 2 == 0, 1024).otherwise(4096).alias("budget"))
    return responses.reanswer(rows, "prompt", "budget", sized_oracle).drop("prompt", "budget")
