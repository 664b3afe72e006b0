"""Suffix-array dedup: threshold-bounded interval expansion.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller identifier, or the
same document and an earlier start) is removed.

The corpus is cut so that equal strings always meet: a window of ``length`` bytes belongs to the
smallest hash of its ``GRAM``-byte grams (a minimizer), so equal windows have equal keys and the windows
of a key form short segments.  Keys that occur once are dropped; the segments of the others go to
the key's task.  There, segments with equal bytes need no comparison: all but the earliest are repeats.
The distinct ones are concatenated and sorted into a suffix array as deep as ``length``, from which the
Burrows-Wheeler transform follows.  Common prefixes are derived from the transform by increasing value: the
intervals of all strings of ``l`` symbols are extended backward by each symbol before them, breadth first;
where an extended interval ends and no shorter string has set a boundary, the suffixes on both sides share
``l`` symbols, and only such intervals are extended further.  The expansion stops at ``length``: what has no
boundary by then shares ``length`` bytes at least.

Copies of whole texts are settled first by digest.  Frequent keys and contents are settled inside the
task that reads them, so a passage in a third of all documents sends a row a task, not a row a document.
A task holds one block of segments.  A key of more than ``HOT`` runs is split: its segments are cut into
single windows, each of which goes, as a 128-bit digest, to a task of its own choice.

Defined results: null is the empty text; texts shorter than ``length`` never match; rows equal in
identifier and text are one document; of equal identifiers with different texts the order is that of
their digests; a null identifier comes last.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import column, discard, fresh, materialise, parts, private, released, remove, slices, table
from evalloom.llm.shingles import mix

LENGTH, GRAM = 100, 32
BLOCK = 3 << 19
#: Runs of a key from which on its windows are compared one by one.
HOT = 10_000
_LAST = (1 << 63) - 1
_RNG = np.random.Generator(np.random.PCG64(5))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = [np.uint64(int(x) * 2 + 1) for x in _RNG.integers(1, 1 << 62, 8, dtype=np.uint64)]


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def runs(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, windows, key and ``inner`` of every run of windows with one minimizer.

    ``inner``: the minimizer may stand in more than one place, so the run may repeat within itself.
    """
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    h, size, level = _BYTE[data], 1, 0
    while size < gram:
        h = h[:-size] * _MULT[level] + h[size:]
        size, level = size * 2, level + 1
    h = mix(h)
    width = length - gram + 1
    low = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)
    by = np.argsort(h[places], kind="stable")
    ordered = places[by]
    near = (h[ordered][1:] == h[ordered][:-1]) & (np.diff(ordered) <= width)
    twice = np.sort(np.concatenate([ordered[1:][near], ordered[:-1][near]]))
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
    at = np.arange(len(low))
    owner = np.searchsorted(ends, at, "right")
    valid = at + length <= ends[owner]
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(low)))
    first, count = first[valid[first]], count[valid[first]]
    if len(count) and count.max() > 256:  # periodic text: pieces of at most 256 windows
        pieces = (count + 255) // 256
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + 256 * rank
        count = np.minimum(256, np.repeat(count, pieces) - 256 * rank)
    doc = owner[first]
    inner = np.searchsorted(twice, first) < np.searchsorted(twice, first + count + width - 1)
    return doc, first - (ends - np.diff(ends, prepend=0))[doc], count, low[first], inner


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` symbols at least, by prefix doubling; only unsettled groups are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    h = 7
    while h < depth:
        open_ = ~new
        open_[:-1] |= ~new[1:]
        where = np.flatnonzero(open_)
        if not len(where):
            break
        pos = order[where]
        both = head[where] * (n + 2) + rank[np.minimum(pos + h, n)]
        again = np.argsort(both)
        order[where] = pos[again]
        both = both[again]
        split = np.ones(len(where), bool)
        split[1:] = both[1:] != both[:-1]
        new[where] = split
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[where]] = head[where]
        h *= 2
    return order


def transform(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform (the symbol before each suffix) and where each place leads when it is extended by its symbol."""
    before = text[order - 1].astype(np.int16)
    leads = np.empty(len(order), np.int64)
    leads[np.argsort(before, kind="stable")] = np.arange(len(order))
    return before, leads


def expand(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares fewer than ``length`` symbols with the one before it in ``order``.

    Symbol 0 parts the segments and is never matched: strings that hold it are not extended, so a boundary
    beside them may be missing, which only joins them with windows that end within their segment.
    """
    n = len(order)
    before, leads = transform(text, order)
    new = np.ones(n, bool)
    new[1:] = before[1:] != before[:-1]
    run_begin = np.append(np.flatnonzero(new), n)  # runs of equal symbols in the transform move together
    run_symbol = before[run_begin[:-1]]
    run_of = np.cumsum(new, dtype=np.int32) - 1
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    ends = np.cumsum(np.bincount(text))
    lo, hi = ends[:-1], ends[1:]  # the intervals of the single symbols but 0
    some = hi > lo
    lo, hi = lo[some], hi[some]
    bound[hi] = True
    for _ in range(1, length):
        if not len(lo):
            break
        first, last = run_of[lo], run_of[hi - 1]
        many = (last - first + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(lo)), many)
        run = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
        run, owner = run[run_symbol[run] != 0], owner[run_symbol[run] != 0]
        if not len(run):
            break
        by = np.argsort(run_symbol[run], kind="stable")
        run, owner = run[by], owner[by]
        a, b = np.maximum(run_begin[run], lo[owner]), np.minimum(run_begin[run + 1], hi[owner])
        start = leads[a]
        # Runs of one interval and one symbol lie side by side after the extension: together they are the new interval.
        head = np.ones(len(run), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (run_symbol[run[1:]] != run_symbol[run[:-1]])
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(run)) - 1
        lo, hi = start[heads], start[tails] + (b - a)[tails]
        fresh = ~bound[hi]
        lo, hi = lo[fresh], hi[fresh]
        bound[hi] = True
    return bound[:n]


def repeats(segments: list[bytes], docs: list[int], starts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every window in distinct segments that also starts earlier."""
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(lens + 1) - (lens + 1)
    text[begin + lens] = 0
    order = suffix_order(text, length)
    bound = expand(text, order, length)
    shared = ~bound
    shared[:-1] |= ~bound[1:]
    group, order = np.cumsum(bound)[shared], order[shared]  # only windows that some other window equals
    seg = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[seg]
    ok = offset + length <= lens[seg]
    group, seg, offset = group[ok], seg[ok], offset[ok]
    doc, start = np.array(docs, np.int64)[seg], np.array(starts, np.int64)[seg] + offset
    by = np.lexsort((start, doc, group))
    group, doc, start = group[by], doc[by], start[by]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    return doc[later], start[later]


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _keys(texts: DataFrame, length: int) -> DataFrame:
    """route, key, known, doc, start, size of every run.  ``known`` runs are repeated for certain and are spread at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(0, np.uint64)
        for b in slices(batches, 1024, most=1 << 20):
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            doc, start, size, key, inner = runs(_bytes(b.column("text")), length)
            if not len(key):
                continue
            distinct, where, count = np.unique(key, return_index=True, return_counts=True)
            met = np.isin(key, often)
            known = met | np.isin(key, distinct[count > 1])
            head = np.zeros(len(key), bool)
            head[where] = True  # the first of each key goes to the key's task, so that others learn of it
            spread = known & (met | ~head)
            known |= inner
            often = np.unique(np.concatenate([often, distinct[count > 1]]))
            if len(often) > 200_000:
                often = often[:0]
            route = np.where(spread, mix(key + mix(start.astype(np.uint64) + ids[doc].astype(np.uint64))), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(key.view(np.int64)), pa.array(known), pa.array(ids[doc]), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(inner)],
                ["route", "key", "known", "doc", "start", "size", "inner"],
            )

    return texts.mapInArrow(run, "route long, key long, known boolean, doc long, start int, size int, inner boolean")


def _repeated(keys: DataFrame) -> DataFrame:
    """The runs whose key occurs more than once.  Rows come sorted by key; one batch is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "start", "size", "inner"]
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            key, known = b.column("key").to_numpy(zero_copy_only=False), b.column("known").to_numpy(zero_copy_only=False)
            route = b.column("route").to_numpy(zero_copy_only=False)
            same = route[1:] == route[:-1]
            twice = known.copy()
            twice[1:] |= same
            twice[:-1] |= same
            last = len(key) - 1
            held = b.slice(last, 1)
            if twice[last]:  # it is settled; whoever follows with its key is too
                held = held.set_column(2, "known", pa.array([True]))
            out = twice.copy()
            out[last] = False
            if out.any():
                got = b.filter(pa.array(out))
                yield pa.RecordBatch.from_arrays([got.column(n) for n in names], names)
        if held is not None and held.column("known")[0].as_py():
            yield pa.RecordBatch.from_arrays([held.column(n) for n in names], names)

    n = parts(keys.sparkSession)
    return keys.repartition(n, "route").sortWithinPartitions("route", "key").mapInArrow(run, "key long, doc long, start int, size int, inner boolean")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """route, doc, start, size, inner, seg: segments to compare; ``seg`` is null for those known to repeat and a digest for single windows of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        windows: dict[bytes, tuple[int, int]] = {}

        def cut(doc: int, start: int, size: int, seg: bytes) -> Iterator[tuple]:
            """The windows of a segment; neighbours known to repeat make one row."""
            since = -1
            for k in range(size):
                name = hashlib.blake2b(seg[k : k + length], digest_size=16).digest()
                earliest = windows.get(name)
                if earliest is not None and earliest < (doc, start + k):
                    since = k if since < 0 else since
                    continue
                if since >= 0:
                    yield ((doc * 31 + start) & _LAST, doc, start + since, k - since, False, None)
                    since = -1
                windows[name] = (doc, start + k)
                yield (int.from_bytes(name[:8], "little", signed=True), doc, start + k, 1, False, name)
            if since >= 0:
                yield ((doc * 31 + start) & _LAST, doc, start + since, size - since, False, None)

        for b in slices(batches, 256, most=1 << 20):
            rows = []
            for doc, raw, found in zip(b.column("doc").to_pylist(), _bytes(b.column("text")), b.column("found").to_pylist(), strict=True):
                for f in found:
                    start, size = f["start"], f["size"]
                    seg = raw[start : start + size + length - 1]
                    earliest = known.get(seg)
                    if earliest is not None and earliest < (doc, start):
                        rows.append(((doc * 31 + start) & _LAST, doc, start, size, False, None))
                        continue
                    known[seg] = (doc, start)
                    if f["hot"]:
                        rows += cut(doc, start, size, seg)
                    else:
                        rows.append((f["key"], doc, start, size, f["inner"], seg))
            if len(known) > 150_000:
                known.clear()
            if len(windows) > 300_000:
                windows.clear()
            for i in range(0, len(rows), 20_000):
                cols = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["route", "doc", "start", "size", "inner", "seg"])

    return texts.mapInArrow(run, "route long, doc long, start int, size int, inner boolean, seg binary")


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Intervals by document, overlapping ones united."""
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    # Running maximum of ends within a document: documents are shifted apart by rank.
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    reach = np.maximum.accumulate(stop + rank * (1 << 40))
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] + rank[1:] * (1 << 40)) > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(start[heads]), pa.array(reach[tails] - rank[tails] * (1 << 40))], ["doc", "a", "b"])


def _marks(segments: DataFrame, length: int) -> DataFrame:
    """doc, a, b: intervals of bytes to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[tuple[int, int, int]] = []  # document, start, end of segments that repeat whole
        block: list[tuple[bytes, int, int]] = []
        size = 0
        key, group, within = None, {}, False

        def close() -> None:
            nonlocal size
            if len(group) > 1 or within:
                real = [(seg, d, s) for seg, (d, s) in group.items() if len(seg) >= length]  # digests are equal or have nothing in common
                block.extend(real)
                size += sum(len(x[0]) for x in real)
            group.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            docs, starts, stops = [np.array([f[i] for f in full], np.int64) for i in range(3)]
            if block:
                d, s = repeats(*map(list, zip(*block, strict=True)), length)
                docs, starts, stops = np.append(docs, d), np.append(starts, s), np.append(stops, s + length)
            full.clear()
            block.clear()
            size = 0
            if len(docs):
                yield _spans(docs, starts, stops)

        for b in slices(batches, 20_000, "seg"):
            for route, doc, start, n, inner, seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seg is None:
                    full.append((doc, start, start + n + length - 1))
                    continue
                if route != key:
                    close()
                    key, within = route, False
                    if size > BLOCK:
                        yield from flush()
                within |= inner
                old = group.get(seg)
                if old is None:
                    group[seg] = (doc, start)
                elif old != (doc, start):
                    group[seg] = min(old, (doc, start))
                    later = max(old, (doc, start))
                    full.append((*later, later[1] + n + length - 1))
            if len(full) > 200_000:
                yield from flush()
        close()
        yield from flush()

    n = parts(segments.sparkSession)
    return segments.repartition(n, "route").sortWithinPartitions("route").mapInArrow(run, "doc long, a long, b long")


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(whole, cut): every row as doc_id, doc (its place in the order), sha, n_bytes and whether it is a later
    copy; and the texts that lose a part, as doc, sha, spans and what is kept.  Both are stored."""
    spark: SparkSession = df.sparkSession
    n = parts(spark)
    docs = df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("doc"), "text", F.sha2("text", 256).alias("sha")
    )
    rows = materialise(docs.select("doc_id", "doc", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    shared = rows.groupBy("doc").agg((F.min("sha") != F.max("sha")).alias("two"), F.count(F.lit(1)).alias("n")).where("n > 1")
    two, same = shared.where("two").limit(1).count(), shared.limit(1).count()
    if two:
        # Identifiers that stand for different texts: documents are renumbered in order of identifier and digest.
        places = materialise(rows.select("doc", "sha").distinct().orderBy("doc", "sha").select("doc", "sha", F.monotonically_increasing_id().alias("place")), "places")
        rows = rows.join(places, ["doc", "sha"]).select("doc_id", F.col("place").alias("doc"), "sha", "n_bytes")
        docs = docs.join(places, ["doc", "sha"]).select("doc_id", F.col("place").alias("doc"), "text", "sha")
    first = materialise(rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("doc").alias("doc")), "first")
    # One shuffle of the texts: what is left is stored in buckets, so that later joins by document move no text.
    name, path = f"evalloom_{uuid.uuid4().hex}", fresh(spark, "texts")
    left = docs.select("doc", "text").where(F.octet_length("text") >= length).repartition(n, "doc")
    # A document has one text by now, so that its number alone tells whether it is the first with its text.
    once = left.join(first.select("doc").repartition(n, "doc").hint("shuffle_hash"), "doc", "left_semi")
    if same:
        once = once.dropDuplicates(["doc"])
    with released(spark):
        once.write.option("compression", "zstd").option("path", path).bucketBy(n, "doc").saveAsTable(name)
    try:
        texts = spark.table(name)
        again = materialise(_repeated(_keys(texts.select("doc", "text"), length)), "again")
        hot = again.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
        marked = again.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        found = marked.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "size", "inner", "hot")).alias("found"))
        segments = _segments(texts.select("doc", "text").join(found, "doc"), length)
        spans = _marks(segments, length).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        cut = materialise(_cut(texts.join(spans, "doc")), "cut")
        discard(spark, again)
    finally:
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)
    whole = rows.join(first.select("sha", F.col("doc").alias("first_doc")), "sha", "left").select("doc_id", "doc", "sha", "n_bytes", (F.col("doc") > F.col("first_doc")).alias("copy"))
    return whole, cut


def _cut(texts: DataFrame) -> DataFrame:
    """doc, spans, n_removed, n_spans, kept_sha256, kept: of what is cut through in the middle of a character ``kept`` holds nothing, the digest all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256, most=1 << 20):
            rows = []
            for doc, raw, spans in zip(b.column("doc").to_pylist(), _bytes(b.column("text")), b.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((x["a"], x["b"]) for x in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for a, e in merged:
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                whole = "".join(k.decode("utf-8", "ignore") for k in kept)
                rows.append((doc, [{"a": a, "b": e} for a, e in merged], len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), whole))
            kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc", "spans", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.select("doc", "text", "spans").mapInArrow(run, "doc long, spans array<struct<a:long,b:long>>, n_removed long, n_spans long, kept_sha256 string, kept string")


def digests(whole: DataFrame, cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    got = whole.join(cut.select("doc", "n_removed", "n_spans", "kept_sha256"), "doc", "left")
    copy = F.coalesce("copy", F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``df`` with their text cut; a multi-byte character that is cut through is dropped, nothing else is."""
    whole, cut = mark(df, id_col, text_col, length)
    sha, name, its, new = private(df, "sha", "name", "its", "new")
    gone = whole.where("copy").select(F.col("doc_id").alias(name), F.col("sha").alias(its), F.lit("").alias(new))
    partly = whole.where("not coalesce(copy, false)").select("doc_id", "doc", "sha").join(cut.select("doc", "kept"), "doc").select(F.col("doc_id").alias(name), F.col("sha").alias(its), F.col("kept").alias(new))
    changes = gone.unionByName(partly).dropDuplicates([name, its])
    text = F.coalesce(column(text_col), F.lit(""))
    rows = df.withColumn(sha, F.sha2(text, 256))
    joined = rows.join(changes, column(id_col).cast("long").eqNullSafe(F.col(name)) & (F.col(sha) == F.col(its)), "left")
    return joined.select(*(F.coalesce(F.col(new), column(c)).alias(c) if c == text_col else column(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*mark(table(spark, sf_dir, "documents")))
