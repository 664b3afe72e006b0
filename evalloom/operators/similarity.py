"""Similarity joins and clustering: TF-IDF, token Jaccard, cosine top-k, greedy passes, soft Jaccard, k-means."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evalloom.functions.text import token_set
from evalloom.operators import ivf
from evalloom.operators.components import connected
from evalloom.operators.lineage import drop, released, stored
from evalloom.operators.vocab import HELD, WORD, repeated, word_frequencies


def tfidf(terms: DataFrame, doc: str = "doc_id", term: str = "term", n_docs: int | Column | None = None) -> DataFrame:
    """doc, term, weight: tf * (ln((1 + N) / (1 + df)) + 1), rows of unit length.  ``terms`` holds one row a token."""
    tf = terms.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    n = terms.select(doc).distinct().count() if n_docs is None else n_docs
    n = F.lit(n) if isinstance(n, int) else n
    raw = tf.join(df, term).withColumn("_w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))  # one shuffle by document; its rows are its distinct terms
    return raw.withColumn("_n", norm).select(doc, term, "tf", "df", (F.col("_w") / F.col("_n")).alias("weight"))


def text_tfidf(df: DataFrame, doc: str, text: str, n_docs: int, known: int | None = None) -> DataFrame:
    """``tfidf``, with tf and df, of the words of texts; rows of one identifier are one document.

    Words are counted within their row.  Tasks know the document frequency of the ``known`` most frequent words, whose rows are not joined;
    a document is shuffled once, as a list, and its other words once more, by word.
    """
    rows = df.select(F.col(doc).alias("_doc"), F.lower(text).alias("_low"))
    twice = repeated(rows.select("_doc"), "_doc")
    if twice is not None:
        two = twice.withColumnRenamed("_doc", "_two")
        same = rows["_doc"].eqNullSafe(two["_two"])
        merged = rows.join(two, same, "left_semi").groupBy("_doc").agg(F.concat_ws(" ", F.collect_list("_low")).alias("_low"))
        rows = rows.join(two, same, "left_anti").unionByName(merged)
    freq = stored(word_frequencies(rows, "_doc", "_low").select("term", "df"), "frequencies")
    top = freq.orderBy(F.desc("df"), "term").limit(WEIGHED if known is None else known)
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in top.toArrow().columns), strict=True)))

    def counted(seen: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df_of = shared.value
            for b in batches:
                at, term, tf = [0], [], []
                for low in b.column(1).to_pylist():
                    for t, n in Counter(WORD.findall(low or "")).items():
                        if (t in df_of) == seen:
                            term.append(t)
                            tf.append(n)
                    at.append(len(term))
                cells = [pa.array(term, pa.string()), pa.array(tf, pa.int64())] + ([pa.array([df_of[t] for t in term], pa.int64())] if seen else [])
                packed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(cells, ["term", "tf", "df"][: len(cells)]))
                yield pa.RecordBatch.from_arrays([b.column(0), packed], ["_doc", "_t" if seen else "_r"])

        return run

    kind = dict(rows.dtypes)["_doc"]
    often = rows.mapInArrow(counted(True), f"_doc {kind}, _t array<struct<term: string, tf: bigint, df: bigint>>")
    rare = rows.mapInArrow(counted(False), f"_doc {kind}, _r array<struct<term: string, tf: bigint>>").select(F.col("_doc").alias("_two"), F.inline("_r"))
    lists = rare.join(freq, "term").groupBy("_two").agg(F.collect_list(F.struct("term", "tf", "df")).alias("_r"))
    both = often.join(lists, often["_doc"].eqNullSafe(lists["_two"]), "left").select("_doc", F.concat("_t", F.coalesce("_r", F.array().cast("array<struct<term: string, tf: bigint, df: bigint>>"))).alias("_t"))
    weight = lambda tf, often: tf * (F.log((1.0 + F.lit(n_docs)) / (1.0 + often)) + 1.0)
    norm = F.sqrt(F.aggregate("_t", F.lit(0.0), lambda s, x: s + F.pow(weight(x["tf"], x["df"]), F.lit(2.0))))
    sized = both.select(F.col("_doc").alias(doc), norm.alias("_n"), "_t")  # before the lists are unpacked, or each row would find the length anew
    return sized.select(doc, "_n", F.inline("_t")).select(doc, "term", "tf", "df", (weight(F.col("tf"), F.col("df")) / F.col("_n")).alias("weight"))


FREQUENT = 65_536  # most frequent tokens that every task knows; their places fit 16 bits
WEIGHED = 50_000  # most frequent terms whose document frequency every task knows
CELL = 4096
HEAVY = 16_384  # rows of a token that meet in one cell
BLOCK = 200_000
MEET = 400_000


def compared(pairs: DataFrame, rows: DataFrame, unpack: Callable, judge: Callable, value: str) -> DataFrame:
    """a, b, value of the pairs (of ``met``) that ``judge`` keeps, by the dot product of their rows.

    A pair goes to the group of the smallest partner of the smallest partner of its ``b``, which near copies share, so a row travels once for each group
    and not for each pair; groups of more than ``CELL`` rows are cut into cells.  ``unpack`` gives terms, weights and sizes
    of a batch of rows; ``judge`` takes dot products, sizes and a size, and gives a mask and values.
    """
    kind = dict(rows.dtypes)["id"]
    first = stored(pairs.repartition("b").sortWithinPartitions("b").mapInArrow(_opened, f"a {kind}, b {kind}, l {kind}"), "links")
    released(rows.sparkSession)
    second = first.where("a = l").select(F.col("b").alias("l"), F.col("l").alias("m"))
    links = stored(first.join(second, "l", "left").select("a", "b", F.coalesce("m", "l").alias("m"), (F.col("a") == F.col("l")).alias("one")), "groups")
    drop(first)
    large = links.where("one").groupBy("m").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).where("cells > 1")
    links = links.withColumn("cells", F.lit(1)) if large.isEmpty() else links.join(large, "m", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("cells")).cast("int")
    links = links.select("a", "b", "m", cell("a").alias("x"), cell("b").alias("y"))
    key = ["m", "x", "y"]
    held = links.select(F.col("a").alias("id"), *key).distinct().withColumn("near", F.array().cast(f"array<{kind}>"))
    asked = links.groupBy(F.col("b").alias("id"), *key).agg(F.collect_list("a").alias("near"))
    full = held.unionByName(asked).join(rows, "id").repartition(*key).sortWithinPartitions(*key, F.size("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, terms, weights, names, dense = None, {}, [], [], None, None
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):  # few rows are unpacked at a time
            flat, weight, size = unpack(batch)
            at = np.concatenate([[0], np.cumsum(size)])
            ids, near = batch.column("id").to_pylist(), batch.column("near")
            asks = np.diff(near.offsets.to_numpy())
            a, b, got = [], [], []
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in key), strict=True)):
                own, w = flat[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                if k != now:
                    now, index, terms, weights, names = k, {}, [], [], None
                if not asks[i]:
                    index.setdefault(ids[i], []).append(len(terms))
                    terms.append(own.copy())
                    weights.append(w.copy())
                    continue
                if names is None:  # the held rows come first: their terms are numbered once
                    names, place = np.unique(np.concatenate(terms), return_inverse=True)
                    terms, dense = np.split(place.astype(np.int32), np.cumsum([len(t) for t in terms])[:-1]), np.zeros(len(names))
                to = np.minimum(np.searchsorted(names, own), len(names) - 1)
                hit = names[to] == own
                dense[to[hit]] = w[hit]
                partners = near[i].as_py()
                for start in range(0, len(partners), 256):
                    some = [(x, p) for x in partners[start : start + 256] for p in index[x]]
                    picks = [p for _, p in some]
                    sizes = np.array([len(terms[p]) for p in picks])
                    dots = np.add.reduceat(dense[np.concatenate([terms[p] for p in picks])] * np.concatenate([weights[p] for p in picks]), np.cumsum(sizes) - sizes)
                    keep, values = judge(dots, sizes, len(own))
                    a += [some[j][0] for j in np.flatnonzero(keep)]
                    b += [ids[i]] * int(keep.sum())
                    got.append(values[keep])
                dense[to[hit]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("id").type), pa.array(b, batch.column("id").type), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["a", "b", value])

    return full.mapInArrow(run, f"a {kind}, b {kind}, {value} double")


def _unlike(col: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, n: int = 3) -> np.ndarray:
    """Whether none of the n terms just before the shared one are shared: of a run of shared terms the first alone makes a pair."""
    back = [col[f"b{k}"] for k in range(n)]
    same = reduce(np.logical_or, ((x[i] == y[j]) & (x[i] != 0) for x in back for y in back))
    return ~same


def _before(tokens: np.ndarray, row: np.ndarray, n: int = 3) -> list[np.ndarray]:
    """The n tokens before each one in its row, 0 where the row has none."""
    out = []
    for k in range(1, n + 1):
        back = np.zeros(len(tokens), tokens.dtype)
        back[k:] = tokens[:-k]
        back[k:][row[k:] != row[:-k]] = 0
        out.append(back)
    return out


def _tokens(text_col: str) -> Column:
    return F.array_sort(F.transform(token_set(F.col(text_col)), lambda t: F.xxhash64(t)))


def _name(tokens: Column) -> Column:
    """128 bits of a set; null where there is no token."""
    return F.when(F.size(tokens) > 0, F.struct(F.xxhash64(tokens).alias("x"), F.xxhash64(F.lit("name"), tokens).alias("y")))


def hashed_sets(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, tokens (64-bit hashes in order) and a 128-bit name of the set of every text; the name is null where there is no token.

    Tokens are stored before anything is asked of them, as each question would cut the text again.
    """
    rows = stored(df.select(F.col(id_col).alias("id"), *keep, _tokens(text_col).alias("tokens")), "token-sets")
    return rows.withColumn("name", _name(F.col("tokens")))


def _listed(names: pa.Array, b: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """b, near: the partners a of each b (places in ``names``, sorted by b and a), whole numbers as compressed gaps."""
    start = np.flatnonzero(np.diff(b, prepend=-1))
    stop = np.append(start[1:], len(b))
    if pa.types.is_integer(names.type):
        value = names.to_numpy()[a].astype(np.int64)
        near = [zlib.compress(np.diff(value[i:j], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for i, j in zip(start, stop, strict=True)]
    else:
        near = [pickle.dumps(names.take(pa.array(a[i:j])).to_pylist()) for i, j in zip(start, stop, strict=True)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(b[start])), pa.array(near, pa.binary())], ["b", "near"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, l (the least a of b) of lists sorted by b, each pair once."""

    def rows(lists: list[bytes], b: object, kind: pa.DataType) -> pa.RecordBatch:
        if pa.types.is_integer(kind):
            a = pa.array(np.unique(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T.copy().view(np.int64)) for x in lists]))).cast(kind)
        else:
            a = pa.array([y for x in lists for y in pickle.loads(x)], kind).unique().sort()  # written by ``_listed``
        return pa.RecordBatch.from_arrays([a, pa.repeat(pa.scalar(b, kind), len(a)), pa.repeat(a[0], len(a))], ["a", "b", "l"])

    now, lists, out, kind = None, [], [], None
    for batch in batches:
        kind = batch.column("b").type
        for b, near in zip(batch.column("b").to_pylist(), batch.column("near").to_pylist(), strict=True):
            if lists and b != now:
                out.append(rows(lists, now, kind))
                lists = []
            now = b
            lists.append(near)
        if sum(x.num_rows for x in out) >= 50_000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if lists:
        out.append(rows(lists, now, kind))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def met(prefix: DataFrame, order: list[Column], place: Callable, reach: Callable, near: Callable) -> DataFrame:
    """b, near (smaller ones as bytes, see ``_listed``) of the pairs of rows (``id``) that share a ``key`` and pass ``near``; a pair may come in several lists.

    Rows come sorted by key and ``order``.  ``place`` gives a row's number (below 32) in that order and ``reach`` the last number that it may meet, so a
    row is held against that stretch alone, ``MEET`` pairs at a time; ``near`` gives a mask over pairs of rows.  Where ``side`` is not 0, rows of
    other sides alone meet (see ``_celled``).
    """
    kind = dict(prefix.dtypes)["id"]

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("id").combine_chunks()
        col = {c: table.column(c).to_numpy() for c in table.column_names if c != "id"}
        names = ids.unique().sort()
        code = pc.index_in(ids, names).to_numpy().astype(np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = col["key"][1:] != col["key"][:-1]
        base, own = np.cumsum(new) * 64.0, place(col)
        count = np.maximum(np.searchsorted(base + own, base + np.minimum(reach(own), 32), "right") - np.arange(len(ids)) - 1, 0)
        total, start, got = np.cumsum(count), 0, []
        while start < len(ids):
            done = total[start] - count[start]
            stop = max(int(np.searchsorted(total, done + MEET, "right")), start + 1)
            some = count[start:stop]
            i = np.repeat(np.arange(start, stop), some)
            j = i + 1 + np.arange(len(i)) - np.repeat(total[start:stop] - some - done, some)
            side = col["side"][i]
            yes = ((side == 0) | (side != col["side"][j])) & (code[i] != code[j])
            i, j = near(col, i[yes], j[yes])
            got.append(np.maximum(code[i], code[j]) * len(names) + np.minimum(code[i], code[j]))
            start = stop
            if sum(map(len, got)) >= 4 * MEET or start == len(ids):
                once = np.unique(np.concatenate(got))
                if len(once):
                    yield _listed(names, once // len(names), once % len(names))
                got = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, tail = [], []  # rows of keys that have ended; rows of the last key
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            if tail and tail[-1].column("key")[0].as_py() != key[0]:
                whole, tail = whole + tail, []
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                whole, tail = [*whole, *tail, b.slice(0, cut)], []
            tail.append(b.slice(cut))
            if sum(x.num_rows for x in whole) >= BLOCK:
                yield from pairs(whole)
                whole = []
        if whole or tail:
            yield from pairs(whole + tail)

    return prefix.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, f"b {kind}, near binary")


def _celled(token: np.ndarray, rows: np.ndarray, fold: np.ndarray, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which row, key and side of the rows of tokens of so many ``rows``: those of a token of more than ``heavy`` are dealt
    by ``fold`` into groups, and every two groups meet in a cell of their own."""
    cells = -(-np.maximum(rows, 1) // heavy)
    which = np.repeat(np.arange(len(token)), cells)
    x, n = (fold % cells)[which], cells[which]
    y = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = np.where(n > 1, np.minimum(x, y) * n + np.maximum(x, y) + 1, 0)
    key = token[which] + cell * np.int64(-7046029254386353131)
    return which, key, np.where((n == 1) | (x == y), 0, np.where(x < y, 1, 2)).astype(np.int8)


NIBBLES = np.abs(np.arange(16)[:, None] - np.arange(16))
NIBBLES = np.minimum(NIBBLES, 16 - NIBBLES)
NIBBLES = (NIBBLES[:, None, :, None] + NIBBLES[None, :, None, :]).reshape(-1).astype(np.uint8)  # what two pairs of counts to 16 differ by


def _sketch(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Four words a set: how many of its tokens fall on each of 64 places, modulo 16.  Sets differ in as many tokens as these counts at least."""
    count = (np.bincount(row * 64 + (flat & 63), minlength=n * 64).reshape(n, 64) & 15).astype(np.uint8)
    return (count[:, ::2] << 4 | count[:, 1::2]).copy().view(np.int64)


def _apart(col: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, differ: Callable, some: int = 100_000) -> np.ndarray:
    """What ``differ`` gives for the 32 bytes (h0 to h3) of pairs of rows."""
    of = lambda at: np.stack([col[f"h{k}"][at] for k in range(4)], 1).view(np.uint8)
    return np.concatenate([np.zeros(0, np.int64), *(differ(of(i[s : s + some]), of(j[s : s + some])) for s in range(0, len(i), some))])


def jaccard_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, group: str | None = None) -> DataFrame:
    """a, b, jaccard of pairs of texts whose token sets reach the threshold, within a group if one is named.

    Tokens are compared as 64-bit hashes; equal token sets are joined once, as one row.  With tokens in order of rising
    frequency two sets can only match if their prefixes share a token (prefix filter), if the tokens after the first
    shared one suffice (positional filter), if their sizes are alike and if counts of their tokens by place (``_sketch``) are.
    The ``FREQUENT`` most frequent tokens come last, by their number; the others, by their hash.  Sets are kept as
    bytes, frequent tokens by the gaps between their numbers.
    """
    keep = [group] if group else []
    hashed = hashed_sets(df, id_col, text_col, keep)
    rows = hashed.where("name is not null and id is not null")
    if group:
        rows = rows.where(F.col(group).isNotNull())
    if repeated(rows.select("id"), "id") is not None:
        rows = rows.dropDuplicates(["id", *keep, "name"])
    rows = rows.withColumn("same", F.struct(*keep, "name"))
    first = rows.groupBy("same").agg(F.min("id").alias("first"))
    copies = stored(rows.select("id", "same").join(first, "same").where("first < id").select("id", "same"), "copies")
    often = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    token, often = often["token"].to_numpy(np.int64), often["count"].to_numpy(np.int64)
    order = np.argsort(token)
    shared = df.sparkSession.sparkContext.broadcast((token, often, order, token[order]))  # FREQUENT tokens at most
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, order, known = shared.value
        for b in batches:
            out = []
            for tokens in b.column("tokens"):
                tokens = tokens.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                yes = known[at] == tokens
                gaps = np.diff(np.sort(order[at[yes]]), prepend=0).astype(np.uint16)
                out.append(np.int32(len(gaps)).tobytes() + tokens[~yes].tobytes() + zlib.compress(gaps.view(np.uint8).reshape(-1, 2).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *keep, "same")), pa.array([len(t) for t in b.column("tokens")], pa.int32()), pa.array(out, pa.binary())], ["id", *keep, "same", "n", "v"])

    named = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *keep, "same"))
    packed = rows.select("id", *keep, "same", "tokens").mapInArrow(pack, f"{named}, n int, v binary")
    sets = stored(packed.join(copies, ["id", "same"], "left_anti").drop("same"), "packed-sets")
    drop(hashed)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, rare ones first, weights of 1 and sizes."""
        names = shared.value[0]
        parts = []
        for v, n in zip(batch.column("v").to_pylist(), batch.column("n").to_pylist(), strict=True):
            m = int(np.frombuffer(v, np.int32, 1)[0])
            gaps = np.frombuffer(zlib.decompress(v[4 + 8 * (n - m) :]), np.uint8).reshape(2, m).T.copy().view(np.uint16).reshape(-1)
            parts += [np.frombuffer(v, np.int64, n - m, 4), names[np.cumsum(gaps, dtype=np.int64)[::-1]]]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return flat, np.ones(len(flat)), batch.column("n").to_numpy().astype(np.int64)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, often, order, known = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            flat, _, size = unpack(b)
            row = np.repeat(np.arange(len(size)), size)
            start = np.cumsum(size) - size
            pos = np.arange(len(flat)) - start[row] + 1
            fold = np.bitwise_xor.reduceat(flat, start) >> 1 & 0x7FFFFFFF
            sketch = _sketch(flat, row, len(size))
            inside = pos <= (size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1)[row]
            token, owner, pos = flat[inside], row[inside], pos[inside]
            at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
            which, key, side = _celled(token, np.where(known[at] == token, often[order[at]], 0), fold[owner], HEAVY)
            before = _before(token, owner, 1)[0][which]
            owner = owner[which]
            cells = [b.column(c).take(pa.array(owner)) for c in ("id", *keep)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(key, pa.int64()), pa.array(side, pa.int8()), pa.array(size[owner], pa.int32()), pa.array(pos[which], pa.int32()), pa.array(before, pa.int64()), *(pa.array(sketch[owner, k], pa.int64()) for k in range(4))], ["id", *keep, "key", "side", "n", "pos", "b0", "h0", "h1", "h2", "h3"])

    found = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *keep))
    prefix = sets.mapInArrow(prefixes, f"{found}, key long, side byte, n int, pos int, b0 long, h0 long, h1 long, h2 long, h3 long")
    if group:
        prefix = prefix.withColumn("key", F.xxhash64("key", group)).drop(group)

    def near(col: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, pos = col["n"].astype(np.int64), col["pos"]
        both = n[i] + n[j]
        yes = (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= both * (threshold / (1 + threshold)) - 1e-6) & _unlike(col, i, j, 1)
        i, j, both = i[yes], j[yes], both[yes]
        differ = _apart(col, i, j, lambda x, y: NIBBLES[(x.astype(np.uint16) << 8) | y].sum(1, dtype=np.int64))
        yes = differ <= both * ((1 - threshold) / (1 + threshold)) + 1e-6
        return i[yes], j[yes]

    pairs = met(prefix, [F.col("n")], lambda col: np.log(col["n"]), lambda own: own - math.log(threshold) + 1e-6, near)
    million = round(threshold * 1_000_000)

    def judge(both: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        union = sizes + size - both
        return both.astype(np.int64) * 1_000_000 >= union.astype(np.int64) * million, both / union  # whole numbers: no rounding up to the threshold

    return compared(pairs, sets.select("id", "n", "v"), unpack, judge, "jaccard").withColumn("jaccard", F.round("jaccard", 6))


def token_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, representative: one row a text, with the smallest id of the texts of equal token sets; texts without tokens represent themselves."""
    name = F.transform(F.array(_tokens(text_col)), _name)[0]  # the text is cut once
    rows = stored(df.select(F.col(id_col).alias("id"), name.alias("name")), "set-names")
    first = rows.where("name is not null").groupBy("name").agg(F.min("id").alias("representative"))
    return rows.join(first, "name", "left").select("id", F.coalesce("representative", "id").alias("representative"))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms (64-bit hashes in order), tf: one row an identifier, counted within the row."""
    hashed = F.transform(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)")), lambda t: F.xxhash64(t))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(hashed, F.array().cast("array<bigint>")).alias("t"))
    twice = repeated(df.select(F.col(id_col).alias("id")), "id")
    if twice is not None:  # texts of one identifier count as one
        two = twice.withColumnRenamed("id", "_two")
        same = rows["id"].eqNullSafe(two["_two"])
        merged = rows.join(two, same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t"))
        rows = rows.join(two, same, "left_anti").unionByName(merged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("t")
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((flat, row))
            flat, row = flat[by], row[by]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
            start = np.flatnonzero(new)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[start], minlength=len(size)))]), pa.int32())
            tf = np.diff(np.append(start, len(flat)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(at, pa.array(flat[start], pa.int64())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], ["id", "terms", "tf"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, terms array<bigint>, tf array<int>")


def term_classes(docs: DataFrame, counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """id, representative: one row a document, with the smallest id of those that hold the same terms equally often (``term_counts``); documents without terms represent themselves."""
    name = F.struct(F.xxhash64("terms", "tf").alias("x"), F.xxhash64(F.lit("name"), "terms", "tf").alias("y"), F.size("terms").alias("n"))
    keys = counts.select("id", F.when(F.size("terms") > 0, name).alias("name"))
    first = keys.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("representative"))
    named = keys.join(first, "name", "left").select("id", F.when(F.col("id").isNotNull(), F.coalesce("representative", "id")).alias("representative"))
    ids = docs.select(F.col(doc).alias("id"))
    if repeated(ids, "id") is None:
        return named
    return ids.join(named, "id", "left")


def _norms(terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """32 bytes for each of the first n terms: the vector's norm from that term on, over each of 32 parts of the terms, in 255ths."""
    square = np.zeros((n, 32))
    square[np.arange(n), terms[:n] & 31] = weights[:n] ** 2
    left = np.bincount(terms & 31, weights=weights**2, minlength=32) - (np.cumsum(square, axis=0) - square)
    return np.minimum(np.rint(255 * np.sqrt(np.maximum(left, 0))), 255).astype(np.uint8)


def cosine_pairs(counts: DataFrame, n_docs: int, copies: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """a, b, cosine of pairs of TF-IDF vectors (``term_counts``) at or above the threshold; ``copies`` (id) are left out.  ``once``:
    ``counts`` is a stored table that nothing else reads, and is deleted.

    With terms in order of rising frequency, what two vectors share from their first shared term on is at
    most the product of their norms from there on, so that term lies where this product reaches the threshold.
    What lies from there on is also as far apart as its norms over 32 parts of the terms, at least (``_norms``).
    The ``WEIGHED`` most frequent terms are known to every task; the others alone are joined with their document frequency.
    """
    spark, kind = counts.sparkSession, dict(counts.dtypes)["id"]
    often = stored(counts.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    top = often.orderBy(F.desc("df"), "token").limit(WEIGHED).toPandas()
    token, freq = top["token"].to_numpy(np.int64), top["df"].to_numpy(np.int64)
    order = np.argsort(token)
    idf = lambda df: np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    shared = spark.sparkContext.broadcast((token, order, token[order], idf(freq), freq))  # WEIGHED terms at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent terms by their place, with how often they come, as bytes; the others as lists."""
        _, order, known, _, _ = shared.value
        for b in batches:
            packed, rest, often_ = [], [], []
            for terms, tf in zip(b.column("terms"), b.column("tf"), strict=True):
                terms, tf = terms.values.to_numpy(zero_copy_only=False), tf.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
                yes = known[at] == terms
                place = order[at[yes]]
                by = np.argsort(place)
                packed.append(zlib.compress(np.diff(place[by], prepend=0).astype(np.uint16).tobytes() + tf[yes][by].astype(np.uint32).tobytes(), 1))
                rest.append(terms[~yes])
                often_.append(tf[~yes])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary()), pa.array(rest, pa.list_(pa.int64())), pa.array(often_, pa.list_(pa.int32()))], ["id", "f", "r", "rtf"])

    rows = stored(counts.where("size(terms) > 0").mapInArrow(split, f"id {kind}, f binary, r array<bigint>, rtf array<int>").join(copies, "id", "left_anti"), "frequent")
    drop(*[counts] * once)
    rare = rows.select("id", F.inline(F.arrays_zip(F.col("r").alias("token"), F.col("rtf").alias("tf")))).toDF("id", "token", "tf").join(often, "token")
    rare = rare.groupBy("id").agg(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token", "tf")).alias("rare"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's norm and, in order of rising frequency, those of its terms that another one may share, as bytes."""
        idfs = shared.value[3]
        for b in batches:
            out = []
            for f, rare in zip(b.column("f").to_pylist(), b.column("rare"), strict=True):
                raw = zlib.decompress(f)
                n = len(raw) // 6
                place, tf = np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.int64), np.frombuffer(raw, np.uint32, n, 2 * n)
                df, token, few = (rare.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)) if rare.is_valid else (np.zeros(0, t) for t in (np.int32, np.int64, np.int32))
                norm = np.sqrt(np.sum((tf * idfs[place]) ** 2) + np.sum((few * idf(df)) ** 2))
                by = np.lexsort((token, df))
                by = by[df[by] > 1]
                parts = [np.array([n, len(by)], np.int32), np.array([norm]), np.frombuffer(raw, np.uint16, n), tf, df[by].astype(np.int32), few[by].astype(np.int32), token[by]]
                out.append(zlib.compress(b"".join(x.tobytes() for x in parts), 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    def unpacked(v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, weights and document frequencies, rare ones first."""
        names, _, _, idfs, freq = shared.value
        raw = zlib.decompress(v)
        n, m = np.frombuffer(raw, np.int32, 2)
        norm = np.frombuffer(raw, np.float64, 1, 8)[0]
        place, tf = np.cumsum(np.frombuffer(raw, np.uint16, n, 16), dtype=np.int64)[::-1], np.frombuffer(raw, np.uint32, n, 16 + 2 * n)[::-1]
        at = 16 + 6 * n
        df, few, token = np.frombuffer(raw, np.int32, m, at), np.frombuffer(raw, np.int32, m, at + 4 * m), np.frombuffer(raw, np.int64, m, at + 8 * m)
        return np.concatenate([token, names[place]]), np.concatenate([few * idf(df), tf * idfs[place]]) / norm, np.concatenate([df, freq[place]])

    vectors = stored(rows.select("id", "f").join(rare, "id", "left").select("id", "f", "rare").mapInArrow(pack, f"id {kind}, v binary"), "vectors")

    drop(rows, often)
    released(spark)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            owner, token, rest, rows, fold, norms = [], [], [], [], [], []  # by vector
            for i, v in enumerate(b.column("v").to_pylist()):
                terms, weights, often = unpacked(v)
                left = np.cumsum(weights[::-1] ** 2)[::-1]  # what lies from a term on
                keep = left >= threshold**2 - 1e-6
                token.append(terms[keep])
                rest.append(np.sqrt(left[keep]))
                rows.append(often[keep])
                owner.append(np.full(len(token[-1]), i))
                fold.append(np.bitwise_xor.reduce(terms) >> 1 & 0x7FFFFFFF if len(terms) else 0)
                norms.append(_norms(terms, weights, len(token[-1])))
            token, owner, fold, norms = np.concatenate(token), np.concatenate(owner), np.array(fold, np.int64), np.concatenate(norms).view(np.int64)
            which, key, side = _celled(token, np.concatenate(rows), fold[owner], HEAVY)
            before, owner = _before(token, owner), owner[which]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner)), pa.array(key, pa.int64()), pa.array(side, pa.int8()), pa.array(np.concatenate(rest)[which], pa.float32()), *(pa.array(x[which], pa.int64()) for x in before), *(pa.array(norms[which, k], pa.int64()) for k in range(4))], ["id", "key", "side", "s", "b0", "b1", "b2", "h0", "h1", "h2", "h3"])

    prefix = vectors.mapInArrow(prefixes, f"id {kind}, key long, side byte, s float, b0 long, b1 long, b2 long, h0 long, h1 long, h2 long, h3 long")

    def near(col: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = _apart(col, i, j, lambda x, y: np.square(x.astype(np.int32) - y).sum(1, dtype=np.int64))
        most = np.square(col["s"][i].astype(float)) + np.square(col["s"][j].astype(float)) - 2 * (threshold - 1e-5)
        yes = apart <= np.square(255 * np.sqrt(np.maximum(most, 0)) + math.sqrt(32))  # each of 32 numbers is rounded by half a 255th at most, in both rows
        i, j = i[yes], j[yes]
        yes = _unlike(col, i, j)
        return i[yes], j[yes]

    pairs = met(prefix, [F.desc("s")], lambda col: -np.log(col["s"].astype(float)), lambda own: -math.log(threshold - 1e-5) - own + 1e-6, near)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [unpacked(v) for v in batch.column("v").to_pylist()]
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), np.array([len(x[0]) for x in got])

    def judge(dots: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return dots >= threshold - 1e-6, dots

    found = compared(pairs, vectors, unpack, judge, "cosine")
    return found.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= threshold)


def greedy_leaders(edges: DataFrame, nodes: DataFrame, id_col: str = "id", rounds: int = 12) -> DataFrame:
    """id, leader: in order of id each row joins the first leader that it has an edge to, or leads.

    A row whose earlier neighbours all follow leads, a row with an earlier neighbour that leads follows.  Both are decided
    for all rows at once, round by round; a group of copies takes two rounds.  What long chains leave open
    after ``rounds`` is passed over in order, a connected component in each group.
    """
    links = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u < v").distinct(), "links")
    open_, settled = links, []
    for _ in range(rounds):
        # Rows that no open link enters lead: their earlier neighbours, if any, follow.
        later = open_.select(F.col("v").alias("id")).distinct()
        lead = stored(open_.select(F.col("u").alias("id")).distinct().join(later, "id", "left_anti"), "lead")
        if lead.isEmpty():
            break
        follow = stored(open_.join(lead.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct(), "follow")
        gone = follow.unionByName(lead)
        left = open_.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(follow.withColumnRenamed("id", "v"), "v", "left_anti")
        # A row whose last open link has gone leads as well.
        left = stored(left, "open")
        alone = open_.select(F.col("v").alias("id")).distinct().join(follow, "id", "left_anti").join(left.select(F.col("v").alias("id")).unionByName(left.select(F.col("u").alias("id"))).distinct(), "id", "left_anti")
        settled.append(lead.unionByName(alone))
        open_ = left
        if open_.isEmpty():
            break
    if not open_.isEmpty():
        settled.append(_led(open_))
    if not settled:
        return nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("leader"))
    leads = reduce(DataFrame.unionByName, settled).distinct()
    joined = links.join(leads.withColumnRenamed("id", "u"), "u", "left_semi").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("leader"))
    return nodes.select(F.col(id_col).alias("id")).join(joined, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _led(links: DataFrame) -> DataFrame:
    """id of the rows that lead among open links, by a pass over each connected component."""

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v in zip(pdf.u, pdf.v, strict=True):
            near.setdefault(v, set()).add(u)
        leads: set = set()
        for n in sorted(set(pdf.u) | set(pdf.v)):
            if not leads & near.get(n, set()):
                leads.add(n)
        return pd.DataFrame({"id": sorted(leads)})

    root = connected(links, "u", "v")
    return links.join(root.select(F.col("node").alias("u"), "root"), "u").groupBy("root").applyInPandas(lead, f"id {dict(links.dtypes)['u']}")


def greedy_drop(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """id, leader of every row: edges join representatives, and a representative's leader holds for all rows of its class.

    A copy has the edges of its representative and comes later, so the first leader near to it is the same.
    """
    leaders = greedy_leaders(edges, classes.select(F.col("representative").alias("id")).distinct())
    return classes.join(leaders.withColumnRenamed("id", "representative"), "representative").select("id", "leader")


def top_neighbours(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", most: int = ivf.CELL, share: float | None = None) -> DataFrame:
    """query, neighbour, similarity of the k nearest by cosine, for a stated set of queries against all rows.

    Exact unless ``share`` names the part of the lists that a query probes; cells hold about ``most`` rows.
    """
    index = ivf.build(base, id_col, vector)
    found = ivf.search(index, queries, k, id_col, vector, share=share or 1.0, exact=share is None, cell=most)
    return found.select("query", "neighbour", "similarity", "rank")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of a small matrix by shortest augmenting paths (minimises the sum)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assign(cost.T)]
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            gap = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free[1:] & (gap < least[1:])
            least[1:][better], way[1:][better] = gap[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _hits(edges: list[tuple[int, int, float]]) -> int:
    """Pairs of the optimal assignment over edges alone; groups that no edge links are assigned on their own."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, j, _ in edges:
        root[top((0, i))] = top((1, j))
    groups: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for e in edges:
        groups.setdefault(top((0, e[0])), []).append(e)
    hits = 0
    for group in groups.values():
        if len(group) == 1:
            hits += 1
            continue
        left, right = ({x: k for k, x in enumerate(sorted({e[side] for e in group}))} for side in (0, 1))
        kept = np.zeros((len(left), len(right)))
        for i, j, s in group:
            kept[left[i], right[j]] = s
        hits += sum(kept[i, j] > 0 for i, j in assign(-kept))
    return hits


def soft_jaccard_value(sim: np.ndarray, threshold: float = 0.8) -> float:
    """Matched pairs at or above the threshold, over the union; any empty side is 0."""
    n, m = sim.shape
    if not n or not m:
        return 0.0
    i, j = np.nonzero(sim >= threshold)
    hits = _hits(list(zip(i.tolist(), j.tolist(), sim[i, j].tolist(), strict=True)))
    return hits / (n + m - hits)


def bigram_matrix(a: list[str], b: list[str]) -> np.ndarray:
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    x, y = [grams(s) for s in a], [grams(s) for s in b]
    at = {g: k for k, g in enumerate(sorted(set().union(*x, *y)))}

    def marks(sets: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sets), len(at)), np.float32)
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), [at[g] for s in sets for g in s]] = 1
        return out

    both = (marks(x) @ marks(y).T).astype(np.float64)
    union = np.array([len(s) for s in x], np.float64)[:, None] + np.array([len(s) for s in y], np.float64) - both
    sim = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    where: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        where.setdefault(t, []).append(j)
    for i, s in enumerate(a):
        sim[i, where.get(s, [])] = 1.0
    return sim


class _Grams(dict):
    """Bigrams of a word, and names of their parts; emptied at ``HELD`` words.

    Sets of n bigrams or more that are alike by ``threshold`` differ in at most k = n * (1 / threshold - 1) bigrams, so that of k + 1 parts
    (by hash) one is equal.  The smaller of the two sets gives n, so a word's parts are named for every k that a smaller set may give.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def __missing__(self, word: str) -> tuple[frozenset[str], list[int]]:
        if len(self) >= HELD:
            self.clear()
        g = frozenset([word[i : i + 2] for i in range(len(word) - 1)])
        differ = lambda n: int(n * (1 / self.threshold - 1) + 1e-9)
        names = []
        for k in range(differ(math.ceil(self.threshold * len(g) - 1e-9)), differ(len(g)) + 1) if g else ():
            parts: list[list[str]] = [[] for _ in range(k + 1)]
            for x in g:
                parts[hash(x) % (k + 1)].append(x)
            names += [hash((k, i, frozenset(part))) for i, part in enumerate(parts)]
        got = self[word] = g, names
        return got


def _soft(a: list[str], b: list[str], threshold: float = 0.8, grams: _Grams | None = None) -> float:
    """Soft Jaccard of two lists; only words that are equal or share a part of their bigrams are compared."""
    grams = _Grams(threshold) if grams is None else grams
    where: dict[int, list[int]] = {}
    same: dict[str, list[int]] = {}
    y = [grams[t] for t in b]
    for j, (_, names) in enumerate(y):
        same.setdefault(b[j], []).append(j)
        for x in names:
            where.setdefault(x, []).append(j)
    edges = []
    for i, word in enumerate(a):
        g, names = grams[word]
        near = dict.fromkeys(same.get(word, ()), 1.0)
        for x in names:
            for j in where.get(x, ()):
                if j not in near:
                    both = len(g & y[j][0])
                    near[j] = both / (len(g) + len(y[j][0]) - both)
        edges += [(i, j, near[j]) for j in sorted(near) if near[j] >= threshold]
    hits = _hits(edges)
    return hits / (len(a) + len(b) - hits) if a and b else 0.0


@F.pandas_udf(DoubleType())
def soft_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Soft Jaccard of two lists of terms, by bigram similarity."""
    grams = _Grams(0.8)
    return pd.Series([_soft(list(x if x is not None else []), list(y if y is not None else []), grams=grams) for x, y in zip(a, b, strict=True)], dtype="float64")


def kmeans(df: DataFrame, k: int = 50, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding", sample: int = ivf.SAMPLE) -> DataFrame:
    """id, cluster (from 0, larger clusters first, equal ones by their first id) by k-means over vectors of unit length, fitted on a
    bounded sample; the same rows give the same clusters.  A table of no more than k rows has a cluster each."""
    rows = ivf.unit(df, id_col, vector)
    kind = dict(rows.dtypes)["id"]
    centre = ivf.centroids(rows, rows.count(), max(sample, 16 * k), seed=seed, lists=k)
    if not len(centre):
        return rows.select("id", F.lit(0).cast("long").alias("cluster"))
    shared = df.sparkSession.sparkContext.broadcast(centre)  # k rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ivf.closest(ivf.matrix(b.column("vector")), shared.value), pa.int64())], ["id", "near"])

    near = stored(rows.mapInArrow(assign, f"id {kind}, near long"), "clusters")
    size = near.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    number = size.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long"))  # k rows at most
    return near.join(F.broadcast(number.select("near", "cluster")), "near").select("id", "cluster")


def name_parents(clusters: DataFrame, cluster: str = "cluster", id_col: str = "id", frequency: str = "frequency") -> DataFrame:
    """id, parent (the cluster's most frequent member, of equals the first), members and total of the parent."""
    best = F.min(F.struct((-F.coalesce(frequency, F.lit(0))).alias("f"), F.col(id_col).alias("id"))).alias("best")
    named = clusters.groupBy(cluster).agg(best, F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(frequency), F.lit(0)).alias("total"))
    return clusters.join(named, cluster).select(F.col(id_col).alias("id"), F.col("best.id").alias("parent"), "members", "total")
