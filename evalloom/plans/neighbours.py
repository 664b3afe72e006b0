"""Queries over vectors: neighbours through the index, the glossary of an item, clusters around leaders."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from evalloom.operators import ivf, leaders, similarity, vocab
from evalloom.operators.lineage import cut
from evalloom.operators.views import read
from evalloom.plans.registry import query
from evalloom.plans.texts import ENUM, STOP


@query("ivf_neighbours", """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), s as (select q.vec_id query, e.vec_id neighbour, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) similarity from q, embeddings e where q.vec_id <> e.vec_id),
 r as (select *, row_number() over (partition by query order by similarity desc, neighbour) rank from s) select query, neighbour, similarity, rank from r where rank <= 10""")
def ivf_neighbours(spark, sf):
    """Nearest 10 of every twentieth vector under full probing of the index, which is exact."""
    e = read(spark, sf, "embeddings")
    return ivf.search(ivf.build(e), e.where("vec_id % 20 = 0"), 10, exact=True)


@query("ivf_probed")
def ivf_probed(spark, sf):
    """The same search in the nearest part of the lists; its recall is in README and tests."""
    e = read(spark, sf, "embeddings")
    return ivf.search(ivf.build(e), e.where("vec_id % 20 = 0"), 10)


def _term_vectors(spark, sf):
    """name, embedding: the mean vector of the items that hold a term of the micro-enum."""
    docs = read(spark, sf, "documents")
    names = [r.name for r in vocab.micro_enum(vocab.word_frequencies(docs, "doc_id", "text"), docs.count(), STOP).collect()]  # 400 at most
    places = docs.select("doc_id", vocab.places(names)(F.col("text")).alias("places")).where("size(places) > 0")
    held = places.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))  # texts of one identifier are one item
    items = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    mean = held.join(items, "doc_id").select(F.explode("places").alias("place"), "v").groupBy("place").agg(Summarizer.mean(F.col("v")).alias("v"))
    name = F.element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("place") + 1)
    return cut(mean.select(name.alias("name"), vector_to_array("v").alias("embedding")))  # a row a name, read three times


@query("item_glossary", f"""with {ENUM}, h as (select p.doc_id, p.term from p join e on e.term = p.term), x as (select vec_id, unnest(embedding)::double c, generate_subscripts(embedding, 1) i from embeddings),
 m as (select term, i, avg(c) c from h join x on x.vec_id = h.doc_id group by 1, 2), v as (select term, list(c order by i) v from m group by 1),
 s as (select vec_id item, term "name", round(list_cosine_similarity(embedding::double[], v), 6) similarity from embeddings, v), r as (select *, row_number() over (partition by item order by similarity desc, "name") rank from s) select * from r where rank <= 30""")
def item_glossary(spark, sf):
    """The 30 terms of the micro-enum nearest to each item; a term lies at the mean of the items that hold it."""
    index = ivf.build(_term_vectors(spark, sf), "name")
    found = ivf.search(index, read(spark, sf, "embeddings"), 30, exact=True, others=False)
    return found.select(F.col("query").alias("item"), F.col("neighbour").alias("name"), "similarity", "rank")


def _weighed(spark, sf):
    """Vectors with their frequency: how many lines order the part of their number."""
    often = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("vec_id")).agg(F.count(F.lit(1)).alias("often"))
    return read(spark, sf, "embeddings").join(often, "vec_id", "left")


@query("leader_clusters")
def leader_clusters(spark, sf):
    """Clusters of each label around leaders, in order of falling frequency."""
    return leaders.leader_clusters(_weighed(spark, sf), "label", threshold=0.35, frequency=F.col("often"))


OFTEN = "o as (select l_partkey vec_id, count(*) often from lineitem group by 1), w as (select e.vec_id id, label, often from embeddings e left join o on o.vec_id = e.vec_id)"


@query("parents_by_frequency", f"""with {OFTEN}, r as (select *, first_value(id) over (partition by label order by coalesce(often, 0) desc, id) parent, count(*) over (partition by label) members, coalesce(sum(often) over (partition by label), 0)::bigint total from w)
 select id, parent, members, total from r""")
def parents_by_frequency(spark, sf):
    """Each cluster is named after its most frequent member."""
    return similarity.name_parents(_weighed(spark, sf), "label", "vec_id", "often")


@query("kmeans_named")
def kmeans_named(spark, sf):
    """The same over 50 clusters by k-means."""
    rows = _weighed(spark, sf)
    clusters = similarity.kmeans(rows, 50).join(rows.select(F.col("vec_id").alias("id"), "often"), "id")
    return similarity.name_parents(clusters, frequency="often")
