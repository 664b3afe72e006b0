"""Queries of what surrounds a run: nested context, files with numbered lines, manifests, audits, selection by name."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.functions import jsonx as J
from evalloom.operators import lineage, manifest, selection
from evalloom.operators.views import read
from evalloom.plans.registry import query
from evalloom.sources import readers


def _nested(concat, props, kind, number, user):
    return concat('{"first": ', props, ', "deep": {"l2": ["', kind, '", {"l3": {"l4": [{"l5": " ', kind, ' \\"x\\\\ "}, ', number, ', null, "', user, ':", []]}}, {"', kind, '": ["a\\nb", true]}]}}')


def _sql_concat(*parts):
    return " || ".join(p if p.isidentifier() else f"({p[1:]})" if p.startswith("=") else "'" + p.replace("'", "''") + "'" for p in parts)


NESTED = _nested(_sql_concat, "props", "event_type", "=event_id::varchar", "=user_id::varchar")


@query("context_lines", f"""with n as (select event_id, {NESTED} j from events), s as (select event_id, t.id, regexp_replace(json_extract_string(t.atom, '$'), '^\\s+|\\s+$', '', 'g') v from n, json_tree(n.j) t where t.type = 'VARCHAR')
 select n.event_id, coalesce(string_agg('Context: ' || v, '|' order by s.id), '') context, count(s.id) strings from n left join s on s.event_id = n.event_id group by 1""")
def context_lines(spark, sf):
    """All strings of an event's properties and of a structure five levels deep around them, in order."""
    lit = lambda *parts: F.concat(*(F.col(p) if p.isidentifier() else F.expr(p[1:]) if p.startswith("=") else F.lit(p) for p in parts))
    j = _nested(lit, "props", "event_type", "=cast(event_id as string)", "=cast(user_id as string)")
    rows = read(spark, sf, "events").select("event_id", J.context_lines(j).alias("c"))
    return rows.select("event_id", F.array_join("c", "|").alias("context"), F.size("c").cast("long").alias("strings"))


TURN = "conv_id long, turn long, text string"
LINES = """n as (select greatest(3, ceil(count(*) / 2000))::bigint parts from conversations), r as (select *, (conv_id * 31 + turn) % parts part, (conv_id * 7 + turn) % 11 = 0 broken from conversations, n),
 x as (select *, unnest(case when turn % 5 = 4 then [0, 1] else [0] end) seq from r), l as (select *, row_number() over (partition by part order by conv_id, turn, text, seq) line from x)"""


def _turn_files(spark, sf):
    """The folder of JSON lines files, one a part, with broken and blank lines among them."""
    turns = read(spark, sf, "conversations")
    parts = max(3, -(-turns.count() // 2000))
    whole = F.to_json(F.struct("conv_id", "turn", "text"))
    line = F.when(F.expr("(conv_id * 7 + turn) % 11 = 0"), F.left(whole, F.length(whole) - 3)).otherwise(whole)
    at = lambda seq, value: F.struct(F.lit(seq).alias("seq"), value.alias("value"))
    seqs = F.when(F.col("turn") % 5 == 4, F.array(at(0, line), at(1, F.lit("")))).otherwise(F.array(at(0, line)))
    rows = turns.withColumn("part", (F.col("conv_id") * 31 + F.col("turn")) % parts).withColumn("s", F.explode(seqs)).select("part", "conv_id", "turn", "text", "s.seq", "s.value")
    folder = lineage.folder(spark, "turns")
    rows.repartition(parts, "part").sortWithinPartitions("part", "conv_id", "turn", "text", "seq").select("part", "value").write.partitionBy("part").text(folder)
    return folder


def _part(c="file"):
    return F.regexp_extract(c, r"part=(\d+)", 1).cast("long").alias("part")


@query("numbered_lines", f"with {LINES} select part, line, conv_id, turn, length(text) chars from l where seq = 0 and not broken")
def numbered_lines(spark, sf):
    """Rows read back from files, with their file and line."""
    good, _ = readers.numbered(spark, _turn_files(spark, sf), StructType.fromDDL(TURN))
    return good.select(_part(), "line", "conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("quarantined_lines", f"with {LINES} select part, line from l where seq = 0 and broken")
def quarantined_lines(spark, sf):
    _, bad = readers.numbered(spark, _turn_files(spark, sf), StructType.fromDDL(TURN))
    return bad.select(_part(), "line")


@query("line_counts", f"with {LINES} select part, count(*) lines, count(*) filter (seq = 1) blank, count(*) filter (seq = 0 and broken) bad, count(*) filter (seq = 0 and not broken) good from l group by 1")
def line_counts(spark, sf):
    """What each file held and what was dropped from it."""
    return readers.line_counts(spark, _turn_files(spark, sf), StructType.fromDDL(TURN)).select(_part(), "lines", "blank", "bad", "good")


def _digest_sql(table: str, columns: list[str]) -> str:
    cells = " || ".join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, 'N')" for c in columns)
    words = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::ubigint)" for k in range(manifest.LANES))
    return f"(select count(*) \"rows\", left(sha256(concat_ws(',', count(*), {words})), 16) dataset_hash from (select sha256({cells}) h from {table}))"


COLUMNS = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"]}
PROMPT = "Name the subdomains and terms of the item."


@query("run_manifest", " union all ".join(f"select '{t}' dataset, left(sha256('{PROMPT}'), 16) prompt_hash, left(sha256('{{}}'), 16) parent_map_hash, '{{\"runs\": 3}}' settings, * from {_digest_sql(t, c)}" for t, c in COLUMNS.items()))
def run_manifest(spark, sf):
    """What a run over each table reads and uses; the digest is the same under any partitioning."""
    rows = [manifest.run_manifest(read(spark, sf, t), t, PROMPT, columns=c, runs=3) for t, c in COLUMNS.items()]
    return readers.union(rows)


@query("removal_audit", """with k as (select *, row_number() over (partition by coalesce(text, '') order by doc_id) i from documents), g as (select doc_id, case when text is null or length(text) < 200 then 'short' else 'repeated' end reason from k where i > 1 or text is null or length(text) < 200)
 select reason, count(*) removed, min(doc_id) first_key, max(doc_id) last_key from g group by rollup (reason)""")
def removal_audit(spark, sf):
    """What a cleaning pass (short texts, repeated texts) removed, by reason and in all."""
    docs = read(spark, sf, "documents")
    short = F.col("text").isNull() | (F.length("text") < 200)
    first = docs.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"), F.md5(F.coalesce("text", F.lit(""))).alias("b")).agg(F.min("doc_id").alias("doc_id"))
    kept = docs.where(~short).join(first.select("doc_id"), "doc_id", "left_semi")
    return manifest.removal_audit(docs, kept, "doc_id", F.when(short, "short").otherwise("repeated"))


ENTRIES = "e as (select p_brand as key, min(p_name) \"name\" from part group by 1)"
ASKED = "case p_partkey % 4 when 0 then p_brand when 1 then ' ' || upper(p_brand) when 2 then replace(p_brand, '#', '-') else p_name end"
SLUG = "regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _forms(c):
    plain, slug = f"lower(trim({c}))", SLUG.format(c=c)
    return [c, plain, slug, f"replace({slug}, '_', '')", f"replace(replace({plain}, '-', ''), '_', '')"]


@query("selection_by_name", f"""with {ENTRIES}, a as (select distinct {ASKED} asked from part), f as (select asked, unnest([{", ".join(_forms("asked"))}]) form from a),
 v as (select key, unnest([{", ".join(_forms("key") + _forms('"name"'))}]) form, unnest(range(10)) rank from e), m as (select asked, key, min(rank) rank from f join v on v.form = f.form and v.form <> '' group by 1, 2),
 b as (select *, min(rank) over (partition by asked) best from m), c as (select asked, min(key) as key, best rank, count(*) candidates from b where rank = best group by asked, best)
 select a.asked, c.key, c.rank::int rank, coalesce(candidates, 0) candidates from a left join c on c.asked = a.asked""")
def selection_by_name(spark, sf):
    """Brands by their names in several spellings, or by the names of parts, which several brands may share."""
    part = read(spark, sf, "part")
    entries = part.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_name").alias("name"))
    asked = part.select(F.expr(ASKED).alias("asked"))
    return selection.select(asked, entries, "asked", "key", ["key", "name"])
