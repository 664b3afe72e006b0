"""Queries over text: vocabulary, similarity, stability, taxonomy, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import arrays as A
from evalloom.functions import jsonx as J
from evalloom.functions import mathx as M
from evalloom.functions import text as T
from evalloom.operators import lineage, similarity, stability, taxonomy, views, vocab
from evalloom.operators.views import QUESTIONS, read
from evalloom.plans.registry import query

TERMS = "t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from documents), p as (select doc_id, term, count(*) n from t group by 1, 2), f as (select term, sum(n)::bigint tf, count(*) df from p group by 1)"
STOP = ["the", "of", "and", "that", "with", "for", "are", "was", "que", "les", "des", "der", "die", "und", "los", "las", "por"]
STOPS = ", ".join(f"'{w}'" for w in STOP)
ENUM = f"{TERMS}, c as (select count(*) n from documents), e as (select term, tf from f, c where length(term) >= 3 and term not in ({STOPS}) and df >= 2 and df <= n * 0.5::double and not regexp_matches(term, '^[0-9]+$') order by tf desc, term limit 400)"


@query("term_df", f"with {TERMS} select * from f")
def term_df(spark, sf):
    return vocab.word_frequencies(read(spark, sf, "documents"), "doc_id", "text")


def _enum(spark, sf):
    docs = read(spark, sf, "documents")
    return vocab.micro_enum(vocab.word_frequencies(docs, "doc_id", "text"), docs.count(), STOP)


@query("micro_enum", f"with {ENUM} select row_number() over (order by tf desc, term) rank, term \"name\", tf frequency, left(sha256(term), 16) id from e")
def micro_enum(spark, sf):
    """The enum's size is its parameter: the 400 most frequent terms."""
    return _enum(spark, sf)


@query("canonicalize_exact_alias", f"""with {ENUM}, l as (select distinct term label from t), a as (select term || 'x' alias, term "name" from e)
 select label, coalesce(e.term, a."name", label) canonical, case when e.term is not null then 'exact' when a."name" is not null then 'alias' else 'none' end tier
 from (select label, case when length(label) > 3 and label like '%s' and label not like '%ss' then left(label, length(label) - 1) else label end norm from l) l left join e on e.term = norm left join a on a.alias = norm""")
def canonicalize_exact_alias(spark, sf):
    enum = _enum(spark, sf)
    labels = vocab.terms(read(spark, sf, "documents"), "doc_id", "text").select(F.col("term").alias("label"))
    return vocab.canonical_exact(labels, enum, enum.select(F.concat("name", F.lit("x")).alias("alias"), "name"))


@query("canonicalize_fuzzy", f"""with {ENUM}, g as (select distinct term label, list_distinct([substr(term, i::int, 2) for i in range(1, length(term))]) gl from t where length(term) >= 2),
 h as (select term "name", list_distinct([substr(term, i::int, 2) for i in range(1, length(term))]) gn from e),
 s as (select label, "name", round(len(list_intersect(gl, gn)) / len(list_distinct(list_concat(gl, gn))), 6) similarity from g, h),
 r as (select *, row_number() over (partition by label order by similarity desc, "name") k from s where similarity >= 0.7) select label, "name" canonical, similarity from r where k = 1""")
def canonicalize_fuzzy(spark, sf):
    docs = read(spark, sf, "documents")
    freq = lineage.stored(vocab.word_frequencies(docs, "doc_id", "text"), "frequencies")  # a row a term: labels and enum
    return vocab.fuzzy(freq.select(F.col("term").alias("label")).where("length(label) >= 2"), vocab.micro_enum(freq, docs.count(), STOP), 0.7)


@query("tfidf_weights", f"""with {TERMS}, c as (select count(distinct doc_id) n from t), w as (select doc_id, p.term, p.n tf, df, p.n * (ln((1.0::double + c.n) / (1.0::double + df)) + 1.0::double) w from p join f on f.term = p.term, c),
 m as (select doc_id, sqrt(sum(w * w)) norm from w group by 1) select w.doc_id, term, tf, df, round(w / norm, 6) weight from w join m on m.doc_id = w.doc_id""")
def tfidf_weights(spark, sf):
    docs = read(spark, sf, "documents")
    with_terms = docs.where(F.lower("text").rlike("[a-z0-9]")).select("doc_id").distinct().count()
    rows = similarity.text_tfidf(docs, "doc_id", "text", with_terms)
    return rows.select("doc_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


VECTORS = f"{TERMS}, c as (select count(*) n from documents), v as (select doc_id, list(term || ' ' || n order by term) k from p group by 1)"


def _counts(spark, sf):
    return similarity.term_counts(read(spark, sf, "documents"), "doc_id", "text")


def _tfidf_pairs(spark, sf):
    docs = read(spark, sf, "documents")
    counts = lineage.stored(_counts(spark, sf), "term-counts")
    classes = lineage.stored(similarity.term_classes(docs, counts), "classes")
    copies = classes.where("id <> representative").select("id").distinct()
    return similarity.cosine_pairs(counts, docs.count(), copies, 0.955, once=True), classes


@query("tfidf_pairs", f"""with {VECTORS}, w as (select doc_id, p.term, p.n * (ln((1.0::double + c.n) / (1.0::double + df)) + 1.0::double) w from p join f on f.term = p.term, c),
 m as (select doc_id, sqrt(sum(w * w)) norm from w group by 1), r as (select min(doc_id) doc_id from v group by k), u as (select w.doc_id, term, w / norm w from w join m on m.doc_id = w.doc_id join r on r.doc_id = w.doc_id)
 select x.doc_id a, y.doc_id b, round(sum(x.w * y.w), 6) cosine from u x join u y on x.term = y.term and x.doc_id < y.doc_id group by 1, 2 having round(sum(x.w * y.w), 6) >= 0.955::double""")
def tfidf_pairs(spark, sf):
    """Pairs of distinct vectors by TF-IDF cosine; documents with equal vectors are represented by the first (see tfidf_members)."""
    return _tfidf_pairs(spark, sf)[0]


@query("tfidf_members", f"with {VECTORS} select d.doc_id id, case when k is null then d.doc_id else min(d.doc_id) over (partition by k) end representative from documents d left join v on v.doc_id = d.doc_id")
def tfidf_members(spark, sf):
    return similarity.term_classes(read(spark, sf, "documents"), _counts(spark, sf))


@query("tfidf_near_dup_drop")
def tfidf_near_dup_drop(spark, sf):
    return similarity.greedy_drop(*_tfidf_pairs(spark, sf))


@query("deduplication_rate")
def deduplication_rate(spark, sf):
    """Share of the documents that the greedy pass over TF-IDF cosines drops."""
    drop = F.coalesce(F.sum((F.col("leader") != F.col("id")).cast("long")), F.lit(0))
    rows = tfidf_near_dup_drop(spark, sf).agg(F.count(F.lit(1)).alias("items"), drop.alias("dropped"))
    return rows.withColumn("rate", F.when(F.col("items") > 0, F.round(F.col("dropped") / F.col("items"), 6)).otherwise(0.0))


PAIRS = """k as (select id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(txt, '')), '[a-z0-9]+'))) tk from src), s as (select tk, min(id) id from k where len(tk) > 0 group by 1),
 j as (select x.id a, y.id b, round(len(list_intersect(x.tk, y.tk)) / len(list_distinct(list_concat(x.tk, y.tk))), 6) jaccard, len(list_intersect(x.tk, y.tk)) * 10 >= len(list_distinct(list_concat(x.tk, y.tk))) * 8 sure from s x, s y where x.id < y.id and least(len(x.tk), len(y.tk)) >= greatest(len(x.tk), len(y.tk)) * 0.8)"""


@query("near_dup_pairs", f"with src as (select doc_id id, text txt from documents), {PAIRS} select a, b, jaccard from j where sure")
def near_dup_pairs(spark, sf):
    """Pairs of distinct token sets; rows with equal sets are represented by the first (see near_dup_members)."""
    return similarity.jaccard_pairs(read(spark, sf, "documents"), "doc_id", "text", 0.8)


@query("near_dup_stems", f"with {QUESTIONS}, src as (select question_id id, stem txt from v_questions), {PAIRS} select a, b, jaccard from j where sure")
def near_dup_stems(spark, sf):
    return similarity.jaccard_pairs(views.questions(spark, sf), "question_id", "stem", 0.8)


MEMBERS = """k as (select id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(txt, '')), '[a-z0-9]+'))) tk from src)
 select id, case when len(tk) > 0 then min(id) over (partition by tk) else id end representative from k"""


@query("near_dup_members", f"with src as (select doc_id id, text txt from documents), {MEMBERS}")
def near_dup_members(spark, sf):
    """Every document with the first one of its token set, which stands for it in near_dup_pairs."""
    return similarity.token_classes(read(spark, sf, "documents"), "doc_id", "text")


@query("near_dup_stem_members", f"with {QUESTIONS}, src as (select question_id id, stem txt from v_questions), {MEMBERS}")
def near_dup_stem_members(spark, sf):
    return similarity.token_classes(views.questions(spark, sf), "question_id", "stem")


@query("greedy_near_dup_drop")
def greedy_near_dup_drop(spark, sf):
    docs = read(spark, sf, "documents")
    return similarity.greedy_drop(similarity.jaccard_pairs(docs, "doc_id", "text", 0.8), similarity.token_classes(docs, "doc_id", "text"))


@query("exact_dup_clusters", "select md5(text) digest, count(*) n, min(doc_id) first_id, max(doc_id) last_id from documents where text is not null group by text having count(*) > 1")
def exact_dup_clusters(spark, sf):
    rows = read(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("contamination_overlap", """with d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w from documents), b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) w from benchmark),
 x as (select doc_id, unnest(w) t from d), y as (select item_id, len(w) n, unnest(w) t from b), o as (select doc_id, item_id, n, count(*) shared from x join y on y.t = x.t group by all)
 select doc_id, item_id, shared, round(shared / n, 6) contained from o where shared >= n * 0.9::double""")
def contamination_overlap(spark, sf):
    return vocab.contained(read(spark, sf, "documents"), read(spark, sf, "benchmark"), 0.9).select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("contained"))


RUNS = """w as (select doc_id id, regexp_extract_all(lower(text), '[a-z0-9]+') l from documents), o as (select id, u term, min(i) pos from (select id, unnest(l) u, generate_subscripts(l, 1) i from w) group by 1, 2),
 l as (select w.id, coalesce(k.d, []) d from w left join (select id, list(term order by pos) d from o group by 1) k on k.id = w.id),
 r as (select id, list_sort(d[1:ceil(len(d) / 2)::int]) a, list_sort(d[ceil(len(d) / 2)::int + 1:]) b from l)"""


def _runs(spark, sf):
    return stability.runs(read(spark, sf, "documents").withColumn("tok", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")))), "doc_id", "tok")


@query("jaccard_runs", f"with {RUNS} select id, len(a) na, len(b) nb, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 1), 6) jaccard from r")
def jaccard_runs(spark, sf):
    return _runs(spark, sf).select("id", F.size("a").cast("long").alias("na"), F.size("b").cast("long").alias("nb"), F.round(A.jaccard_full(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("consensus_k2", f"""with {RUNS}, c as (select id, list_sort(list_intersect(a, b)) x, list_sort(list_distinct(list_concat(a, b))) u from r)
 select id, array_to_string(list_sort(list_concat(x, list_filter(u, lambda t: not list_contains(x, t)))[1:12]), ',') terms from c""")
def consensus_k2(spark, sf):
    return stability.consensus_terms(_runs(spark, sf)).select("id", F.array_join("terms", ",").alias("terms"))


def nsi_sql(source: str, shifts: int = 100) -> str:
    """Observed and shifted Jaccard over ``source`` (id, a, b), in the circle of the seeded digests."""
    both = "len(list_intersect(x.a, {y}.b))"
    jac = lambda y: f"case when len(list_distinct(list_concat(x.a, {y}.b))) = 0 then 1 else {both.format(y=y)}::double / len(list_distinct(list_concat(x.a, {y}.b))) end"
    return f"""{source}, g as (select *, row_number() over (order by md5('42:' || id::varchar), lpad(id::varchar, 24, '0')) - 1 i, count(*) over () n from z), s as (select unnest(range(1, {shifts} + 1)) s),
 o2 as (select count(*) items, avg({jac("x")}) o from g x), r2 as (select avg({jac("y")}) r from g x, s, g y where s.s < x.n and y.i = (x.i + s.s) % x.n)
 select items, round(o, 6) jaccard_observed, round(r, 6) jaccard_random, round(case when r is null or o is null then 0 when r >= 1 then 1 when r >= o then 0 else (o - r) / (1 - r) end, 6) nsi from o2, r2"""


@query("nsi_closed_form", nsi_sql(f"with {RUNS}, z as (select * from r)"))
def nsi_closed_form(spark, sf):
    return stability.nsi(_runs(spark, sf))


@query("cosine_topk", """with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), s as (select q.vec_id query, e.vec_id neighbour, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) c from q, embeddings e where q.vec_id <> e.vec_id),
 r as (select *, row_number() over (partition by query order by round(c, 6) desc, neighbour) rank from s) select query, neighbour, round(c, 6) similarity, rank from r where rank <= 30""")
def cosine_topk(spark, sf):
    """Nearest 30 of every query vector; queries are the rows whose id is divisible by 50."""
    e = read(spark, sf, "embeddings")
    return similarity.top_neighbours(e.where("vec_id % 50 = 0"), e, 30)


@query("kmeans_parents")
def kmeans_parents(spark, sf):
    return similarity.kmeans(read(spark, sf, "embeddings"), 50, 42)


@query("soft_jaccard")
def soft_jaccard(spark, sf):
    r = _runs(spark, sf)
    return r.select("id", F.round(similarity.soft_jaccard("a", "b"), 6).alias("soft_jaccard"))


def _contains(col: str, keys: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{k.lower()}')" for k in keys) + ")"


def _words(table: dict) -> str:
    return "list_sort(list_filter([" + ", ".join(f"case when {_contains('s', keys)} then '{p}' end" for p, keys in table.items()) + "], lambda x: x is not null))"


@query("taxonomy_tags", f"with d as (select doc_id, lower(text) s from documents) select doc_id, array_to_string({_words(taxonomy.CS_PARENTS)}, ',') cs, array_to_string({_words(taxonomy.MATH_PARENTS)}, ',') math from d")
def taxonomy_tags(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", taxonomy.text_parents(F.col("text"), taxonomy.CS_PARENTS, taxonomy.MATH_PARENTS).alias("p"))
    return d.select("doc_id", F.array_join("p.t0", ",").alias("cs"), F.array_join("p.t1", ",").alias("math"))


ENDINGS = {"nasal": ["tion", "ation"], "liquid": ["ly", "able"], "open": ["ou", "ea"]}


@query("first_match_category", "with s as (select doc_id, lower(string_split(text, ' ')[1]) w from documents) select doc_id, case " + " ".join(f"when {_contains('w', k)} then '{c}'" for c, k in ENDINGS.items()) + " else '' end category from s")
def first_match_category(spark, sf):
    return read(spark, sf, "documents").select("doc_id", taxonomy.first_category(F.split("text", " ")[0], ENDINGS, whole_words=False).alias("category"))


@query("tiered_tags", f"""with d as (select doc_id, lower(string_split(text, chr(10))[1]) v, lower(text) s from documents),
 a as (select doc_id, list_filter([{", ".join(f"case when {_contains('v', k)} then '{c}' end" for c, k in sorted(ENDINGS.items()))}], lambda x: x is not null) one, {_words(taxonomy.MATH_PARENTS)} two from d)
 select doc_id, array_to_string(case when len(one) > 0 then one when len(two) > 0 then two else ['general'] end, ',') tags from a""")
def tiered_tags(spark, sf):
    d = read(spark, sf, "documents")
    first, whole = F.split("text", "\n")[0], F.col("text")
    tags = F.when(F.size(taxonomy.parents(F.array(first), ENDINGS)) > 0, taxonomy.tiered(F.array(first), ENDINGS, taxonomy.MATH_PARENTS, "general")).otherwise(taxonomy.tiered(F.array(whole), {}, taxonomy.MATH_PARENTS, "general"))
    return d.select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("extract_numeric", r"select conv_id, turn, try_cast(nullif(regexp_extract(text, '[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?'), '') as double) number from conversations")
def extract_numeric(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", M.extract_numeric(F.col("text")).alias("number"))


@query("score_numeric", "select event_id, abs(value - round(value, 1)) <= greatest(1e-6::double, abs(round(value, 1)) * 1e-4::double) ok from events")
def score_numeric(spark, sf):
    return read(spark, sf, "events").select("event_id", M.close(F.col("value"), F.round("value", 1)).alias("ok"))


@query("parse_choices", "select conv_id, turn, nullif(regexp_extract(upper(text), '[A-E]'), '') single, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(coalesce(text, '')), '[A-E]'))), '') multi from conversations")
def parse_choices(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", A.parse_single(F.col("text")).alias("single"), F.array_join(A.parse_multi(F.col("text")), "").alias("multi"))


@query("score_choice_set", """with s as (select conv_id, turn, list_sort(list_distinct(regexp_extract_all(upper(coalesce(text, '')), '[A-E]'))) g from conversations), p as (select *, lag(g) over (partition by conv_id order by turn) h from s)
 select conv_id, turn, h is not null and g = h ok from p""")
def score_choice_set(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "conversations").select("conv_id", "turn", A.parse_multi(F.col("text")).alias("g"))
    prev = F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", F.coalesce(prev == F.col("g"), F.lit(False)).alias("ok"))


@query("json_props", "select event_id, json_extract_string(props, '$.page') page, json_extract_string(props, '$.k') k from events")
def json_props(spark, sf):
    v = J.json_blob(F.col("props"))
    return read(spark, sf, "events").select("event_id", J.path(v, "page").alias("page"), J.path(v, "k").alias("k"))


@query("json_repair")
def json_repair(spark, sf):
    broken = F.concat(F.lit('[{"role": "'), "role", F.lit('", "text": "'), F.replace("text", F.lit('"'), F.lit('\\"')), F.lit('"'))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(J.complete_objects(broken)).alias("objects"), J.repaired(broken).alias("repaired"))


@query("url_family", """with h as (select page_id, lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '[^\\p{L}\\p{N}]+', '_', 'g')) slug from pages) select page_id, slug, split_part(regexp_replace(slug, '^_+|_+$', '', 'g'), '_', 1) family from h""")
def url_family(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return read(spark, sf, "pages").select("page_id", T.slugify(host).alias("slug"), T.family_of(host).alias("family"))


@query("slugify_source", "select source, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') slug, count(*) n from documents group by 1, 2")
def slugify_source(spark, sf):
    return read(spark, sf, "documents").select("source", T.slugify(F.concat_ws(" / ", "source", "lang")).alias("slug")).groupBy("source", "slug").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_text_functions", r"""with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') s from documents), n as (select doc_id, s, regexp_replace(regexp_replace(replace(lower(s), '’', ''''), '\s+', ' ', 'g'), '[.!?]$', '') x from t)
 select doc_id, md5(x) digest, len(list_distinct(list_filter(string_split_regex(lower(s), '[^a-z0-9]+'), lambda w: w <> ''))) tokens, regexp_matches(s, '[\x{4e00}-\x{9fff}]') han from n""")
def normalize_text_functions(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(t)).alias("digest"), F.size(T.token_set(t)).cast("long").alias("tokens"), T.is_chinese(t).alias("han"))


@query("anchored_terms", f"""with {ENUM}, d as (select doc_id, lower(text) s from documents), top as (select list(term order by tf desc, term) l from (select * from e order by tf desc, term limit 40))
 select doc_id, len(list_filter(l, lambda x: contains(s, x))) anchored from d, top""")
def anchored_terms(spark, sf):
    top = [r.name for r in _enum(spark, sf).where("rank <= 40").orderBy("rank").collect()]
    return read(spark, sf, "documents").select("doc_id", vocab.held_terms(top)(F.col("text")).alias("anchored"))


@query("anchored_terms_all", f"""with {ENUM}, d as (select doc_id, lower(text) s from documents), l as (select list(term) l from e)
 select doc_id, len(list_filter(l, lambda x: contains(s, x))) anchored from d, l""")
def anchored_terms_all(spark, sf):
    """anchored_terms over the whole enum."""
    names = [r.name for r in _enum(spark, sf).orderBy("rank").collect()]
    return read(spark, sf, "documents").select("doc_id", vocab.held_terms(names)(F.col("text")).alias("anchored"))
