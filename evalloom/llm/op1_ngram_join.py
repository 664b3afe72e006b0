"""N-gram Jaccard join with PartEnum signatures.

Sets of word shingles link when their Jaccard similarity is at least a threshold.  Sizes fall into
overlapping bands such that any two linked sets share one; within a band the similarity bounds the
Hamming distance by ``k``.  PartEnum then splits the hashed feature domain into more than ``k / 2`` parts,
each into two sub-parts; two sets within distance ``k`` differ in at most one element of some part, so
they agree on one of its sub-parts, and every choice of a sub-part gives one signature.  No link is
missed.  A signature over no element at all would be shared by chance.  There are ``spare`` parts more
than the bound needs, so a set may leave out its empty signatures as long as no more than ``spare``
parts have one; otherwise they are replaced by the signatures of an independent second partitioning
under their name.  Either way the guarantee holds.

Copies share one set and are joined by its digest alone.  Sets that share a signature meet at the
smallest of them, their centre (a star), streamed in sorted order, so no pairs within a signature are
made.  A star is split by hash into chunks of bounded size, each with the centre, so that a large one is
spread over tasks.  Short histograms of the sets bound distances from below and drop what can link with
nothing in its star.  In a chunk every member is reduced to its difference from the centre.  Members close to
the centre are linked through it; for each other one, a stray, the overlaps of its difference with those of all
members follow from an inverted index over the differences and give the exact similarity to each.  Strays of
split stars visit the other chunks of their star the same way, streaming past what a chunk holds.  Only links
that join different groups are emitted, so a chunk emits no more links than it has rows.

Defined results: null and empty texts, and texts without words, have the empty set and link with
nothing; texts shorter than a shingle form one shingle.  Rows with equal identifiers stay separate
rows, each with the links of its own text, and so do rows without an identifier, which never name a
component unless no other row does (then it is null).  Of a component's rows the first, by identifier and
then by the hash of the text, is its leader; equal rows lead together.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import shingles
from evalloom.llm.common import discard, id_text, materialise, parts, slices, table, text_key
from evalloom.llm.components import components

WORDS, NUM, DEN = 4, 85, 100
SUB = 2
WIDTH = 1.3  # of a band of smallest sizes


def set_id(got: np.ndarray) -> int:
    """Signed 64-bit digest of a set; 0 for the empty one."""
    return int.from_bytes(hashlib.blake2b(got.tobytes(), digest_size=8).digest(), "little", signed=True) or 1 if len(got) else 0


@lru_cache(1)
def band_starts() -> list[int]:
    starts, x = [], 1
    while x < 1 << 40:
        starts.append(x)
        x = max(x + 1, int(x * WIDTH))
    return starts


@lru_cache(100_000)
def bands(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(band, Hamming bound, smallest size) of each band that a set of this size belongs to.

    Band i serves pairs whose smaller set has a size from s[i] to s[i+1] - 1; the larger has at most
    den/num times that.  With |x & y| >= t / (1 + t) (|x| + |y|) the distance is at most
    (1 - t) / (1 + t) (|x| + |y|).
    """
    out, starts = [], band_starts()
    for i, lo in enumerate(starts[:-1]):
        if lo > size:
            break
        small = starts[i + 1] - 1
        large = small * den // num
        if size <= large:
            out.append((i, (den - num) * (small + large) // (den + num), lo))
    return out


@lru_cache(10_000)
def spare(n: int, least: int) -> int:
    """Parts beyond the ``n`` that the bound needs: as many as will have an empty sub-part in sets of
    the band's smallest size, and two standard deviations more."""
    if n < 4:
        return 0
    for extra in range(n):
        total = n + extra
        expected = total * (1 - (1 - math.exp(-least / (total * SUB))) ** SUB)
        if extra >= expected + 2 * math.sqrt(expected):
            return extra
    return n


def _part_enum(got: np.ndarray, k: int, least: int, tag: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set for distance ``k``, which of them cover no element, and how many parts may have such."""
    with np.errstate(over="ignore"):
        base = shingles.mix(np.array([tag * 1_000_003 + seed], np.uint64))[0]
        if k == 0:
            return shingles.mix(np.array([got.sum(dtype=np.uint64) + base], np.uint64)), np.zeros(1, bool), 0
        extra = spare(k // 2 + 1, least)
        n = k // 2 + 1 + extra
        mixed = shingles.mix(got + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
        cell = ((mixed >> np.uint64(32)) % np.uint64(n * SUB)).astype(np.int64)
        total = np.zeros(n * SUB, np.uint64)
        np.add.at(total, cell, mixed)
        empty = np.bincount(cell, minlength=n * SUB) == 0
        names = np.arange(1, n * SUB + 1, dtype=np.uint64)
        return shingles.mix(total + shingles.mix(names + base)), empty, extra


def signatures(got: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """PartEnum signatures of a sorted distinct set of shingle hashes."""
    out = []
    for band, k, least in bands(len(got), num, den):
        sig, empty, extra = _part_enum(got, k, least, band, 0)
        out.append(sig[~empty])
        if np.count_nonzero(empty.reshape(-1, SUB).any(1) if k else empty) > extra:
            out += [_part_enum(got, k, least, (band << 32) + name + 1, 1)[0] for name in np.flatnonzero(empty).tolist()]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _raws(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in b.column("text").to_pylist()]


def histogram(got: np.ndarray) -> bytes:
    """Counts of a set's hashes in a power of two of cells, about eight to a cell.

    The sum of absolute differences of two histograms is never more than the sets' symmetric difference.
    """
    cells = 1 << min(16, max(5, (len(got) // 8).bit_length()))
    return np.minimum(np.bincount((got >> np.uint64(40)).astype(np.int64) & (cells - 1), minlength=cells), 255).astype(np.uint8).tobytes()


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, ident, n_shingles, sid (digest of the set), hist (its histogram) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024, most=2 << 20):
            got = shingles.sets(_raws(b), k)
            made = [pa.array([len(g) for g in got], pa.int64()), pa.array([set_id(g) for g in got], pa.int64()), pa.array(map(histogram, got), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), b.column("ident"), *made], ["doc_id", "text_key", "ident", "n_shingles", "sid", "hist"])

    return docs.mapInArrow(run, "doc_id long, text_key long, ident long, n_shingles long, sid long, hist binary")


def signed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """sig, sid: the signatures of every distinct set of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, 256, most=1 << 20):
            sigs, sids = [], []
            for g in shingles.sets(_raws(b), k):
                sid = set_id(g)
                if sid and sid not in seen:
                    seen.add(sid)
                    s = signatures(g, num, den)
                    sigs.append(s)
                    sids.append(np.full(len(s), sid, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(sids))], ["sig", "sid"])

    return docs.select("text").mapInArrow(run, "sig long, sid long")


def stars(sigs: DataFrame) -> DataFrame:
    """a, b: the smallest set of each signature with every other one.  Rows arrive sorted; memory is one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0, lead0 = None, None
        done: set[tuple[int, int]] = set()
        for b in batches:
            sig, sid = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if not len(sig):
                continue
            new = np.empty(len(sig), bool)
            new[0] = sig[0] != sig0
            np.not_equal(sig[1:], sig[:-1], out=new[1:])
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            lead = np.where(group >= 0, sid[heads[np.maximum(group, 0)]] if len(heads) else 0, lead0 if lead0 is not None else 0)
            sig0, lead0 = sig[-1], int(lead[-1])
            other = lead != sid
            pairs = np.unique(np.stack([lead[other], sid[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
            if len(done) > 500_000:
                done.clear()  # only saves rows; repeats are removed later
            fresh = [p for p in map(tuple, pairs.tolist()) if p not in done]
            done.update(fresh)
            if fresh:
                x, y = zip(*fresh, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    n = parts(sigs.sparkSession)
    return sigs.repartition(n, "sig").sortWithinPartitions("sig", "sid").mapInArrow(run, "a long, b long").distinct()


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """sid, hashes (sorted distinct 64-bit hashes) of the texts whose set is the one named ``sid``.

    Rows equal in identifier and text give their set more than once, which changes no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512, most=1 << 20):
            # Texts come by identifier, which others may share: only the wanted set is let through.
            got = [(sid, g.tobytes()) for sid, g in zip(b.column("sid").to_pylist(), shingles.sets(_raws(b), k), strict=True) if set_id(g) == sid]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], ["sid", "hashes"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, hashes binary")


#: A chunk of a star has about this many members and shingles at most; the solver's memory is in proportion.
MEMBERS, SHINGLES = 16_384, 4_000_000


def chunked(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, chunk, chunks, b: the stars' rows dealt to the chunks of their star, with the centre's own row (a, a) in each chunk.

    The rows of a chunk are bounded, its star's are not: members are dealt by hash.
    """
    stars_ = pairs.join(sizes.select(F.col("sid").alias("b"), "n_shingles"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("n"))
    counts = stars_.select("a", F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("n") / SHINGLES)).cast("int").alias("chunks"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "chunks", "b")
    centres = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", F.col("a").alias("b"))
    return members.unionByName(centres)


def visits(rows: DataFrame, strays: DataFrame) -> DataFrame:
    """a, chunk, visitor, b: strays of split stars once for each other chunk of their star, and the rows of these stars as hosts."""
    other = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))
    guests = strays.select("a", F.explode(other).alias("chunk"), F.lit(True).alias("visitor"), "b")
    hosts = rows.join(strays.select("a").distinct(), "a", "left_semi").select("a", "chunk", F.lit(False).alias("visitor"), "b")
    return hosts.unionByName(guests)


def by_chunk(rows: DataFrame, run, schema: str, *order: str) -> DataFrame:
    """``run`` over rows that come chunk by chunk, the centre's own row first."""
    n = parts(rows.sparkSession)
    first = rows.withColumn("rest", F.col("b") != F.col("a"))
    return first.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", *order, "rest", "b").mapInArrow(run, schema)


def far(counts: np.ndarray, sizes: np.ndarray, count: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
    """Which of several histograms are too far from one for a link."""
    return np.abs(counts - count).sum(1) * (den + num) > (sizes + size) * (den - num)


class Histograms:
    """The histograms of a chunk, folded to the width of the shortest."""

    def __init__(self, hists: list[bytes], sizes: list[int]):
        self.cells = min(map(len, hists))
        self.counts = np.stack([self.fold(h, self.cells) for h in hists])
        self.sizes = np.array(sizes, np.int64)

    @staticmethod
    def fold(hist: bytes, cells: int) -> np.ndarray:
        return np.frombuffer(hist, np.uint8).astype(np.int32).reshape(-1, cells).sum(0)

    def near(self, hist: bytes, size: int, num: int, den: int) -> np.ndarray:
        cells = min(self.cells, len(hist))
        counts = self.counts if cells == self.cells else self.counts.reshape(len(self.counts), -1, cells).sum(1)
        return ~far(counts, self.sizes, self.fold(hist, cells), size, num, den)

    def linked(self, num: int, den: int) -> np.ndarray:
        """Which may link with another one of the chunk.  Those near the centre, which comes first, need no more than that.

        The centre stays with any other that does, near to it or not: differences are taken from its row.
        """
        out = ~far(self.counts, self.sizes, self.counts[0], int(self.sizes[0]), num, den)
        for i in np.flatnonzero(~out[1:]) + 1:
            near = ~far(self.counts, self.sizes, self.counts[i], int(self.sizes[i]), num, den)
            near[i] = False
            out[i] = bool(near.any())
        out[0] = bool(out[1:].any())
        return out


def thinned(rows: DataFrame, hists: DataFrame, num: int, den: int) -> DataFrame:
    """a, chunk, chunks, b: ``rows`` without the sets that can't link within their star; a star in which nothing can goes.

    The test is a lower bound on the distance, so no link is lost.
    """
    full = rows.join(hists.withColumnRenamed("sid", "b"), "b").select("a", "chunk", "chunks", "b", "n_shingles", "hist")
    schema = "a long, chunk int, chunks int, b long, kept boolean"
    names = ["a", "chunk", "chunks", "b", "kept"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members that may link within their chunk, and the strays of split stars."""
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if held:
                keep = Histograms([h[5] for h in held], [h[4] for h in held]).linked(num, den)
                split = held[0][2] > 1
                out.extend((*h[:4], bool(k)) for h, k in zip(held, keep.tolist(), strict=True) if k or (split and h[0] != h[3]))
                held.clear()

        for b in slices(batches, 2048, "hist", 4 << 20):
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "chunk", "chunks", "b", "n_shingles", "hist")), strict=True):
                if held and held[0][:2] != row[:2]:
                    close()
                held.append(row)
            if len(out) > 20_000:
                yield batch(out)
                out.clear()
        close()
        if out:
            yield batch(out)

    keys = ["a", "chunk", "chunks", "b"]
    tested = materialise(by_chunk(full, inside, schema), "tested")
    strays, kept = tested.where("not kept").select(keys), tested.where("kept").select(keys)
    if not strays.limit(1).count():
        return kept

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strays that may link in a chunk they visit."""
        held: list[tuple] = []
        seen: Histograms | None = None
        out: list[tuple[int, int]] = []
        for b in slices(batches, 2048, "hist", 4 << 20):
            for a, chunk, visitor, other, size, hist in zip(*(b.column(c).to_pylist() for c in ("a", "chunk", "visitor", "b", "n_shingles", "hist")), strict=True):
                if held and held[0][:2] != (a, chunk):
                    held, seen = [], None
                if not visitor:
                    held.append((a, chunk, hist, size))
                    continue
                if seen is None and held:
                    seen = Histograms([h[2] for h in held], [h[3] for h in held])
                if seen is not None and seen.near(hist, size, num, den).any():
                    out.append((a, other))
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    met = visits(rows, strays).join(hists.withColumnRenamed("sid", "b"), "b")
    saved = by_chunk(met, across, "a long, b long", "visitor").distinct()
    kept = kept.unionByName(strays.join(saved, ["a", "b"], "left_semi").select(keys))
    # A chunk all of whose members came back by a visit has lost its centre's row.
    centres = kept.select("a", "chunk", "chunks", F.col("a").alias("b"))
    return kept.unionByName(centres).distinct()


class Star:
    """A chunk: the centre and the members that came so far, as differences from it."""

    def __init__(self, sid: int, got: np.ndarray, num: int, den: int):
        self.sid, self.got, self.num, self.den = sid, got, num, den
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.diffs: list[np.ndarray] = []

    def add(self, sid: int, got: np.ndarray) -> None:
        self.ids.append(sid)
        self.sizes.append(len(got))
        self.diffs.append(np.setxor1d(self.got, got, assume_unique=True))

    def close(self) -> None:
        """All members are here: find those linked to the centre and index the differences."""
        self.size = np.array(self.sizes, np.int64)
        self.apart = np.array([len(d) for d in self.diffs], np.int64)
        self.linked = self._ok(self.size, len(self.got), self.apart)
        # group[i]: the members known to be connected; all that are linked to the centre are.
        self.group = np.arange(len(self.size))
        if self.linked.any():
            self.group[self.linked] = np.flatnonzero(self.linked)[0]
        self.value: np.ndarray | None = None

    def _index(self) -> None:
        member = np.repeat(np.arange(len(self.size)), self.apart)
        every = np.concatenate([*self.diffs, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.value, begin = np.unique(every[order], return_index=True)
        self.members, self.begin = member[order], np.append(begin, len(every))

    def near(self, size: int, diff: np.ndarray) -> np.ndarray:
        """Which members link with a set of this size and difference from the centre."""
        if self.value is None:
            self._index()
        at = np.searchsorted(self.value, diff)
        at = at[(at < len(self.value)) & (self.value[np.minimum(at, len(self.value) - 1)] == diff)] if len(self.value) else at[:0]
        held = [self.members[self.begin[v] : self.begin[v + 1]] for v in at.tolist()]
        overlap = np.bincount(np.concatenate(held), minlength=len(self.size)) if held else np.zeros(len(self.size), np.int64)
        return self._ok(self.size, size, self.apart + len(diff) - 2 * overlap)

    def join(self, sid: int, near: np.ndarray, own: int | None = None) -> list[tuple[int, int]]:
        """One link from a set to each group it is near to but not in; these groups are one from now on."""
        groups = np.unique(self.group[near])
        if own is not None:
            groups = groups[groups != own]
        out = []
        for g in groups.tolist():
            v = self.ids[int(np.flatnonzero(near & (self.group == g))[0])]
            if v != sid:
                out.append((min(sid, v), max(sid, v)))
        if len(groups):
            self.group[np.isin(self.group, groups)] = groups[0] if own is None else own
        return out

    def strays(self) -> list[int]:
        return np.flatnonzero(~self.linked).tolist()

    def links(self) -> list[tuple[int, int]]:
        """Links that span the groups of the chunk, each verified exactly."""
        out = [(self.sid, self.ids[i]) for i in np.flatnonzero(self.linked).tolist()]
        if len(self.ids) > 1:
            for u in self.strays():
                out += self.join(self.ids[u], self.near(self.sizes[u], self.diffs[u]), int(self.group[u]))
        return out

    def _ok(self, n: np.ndarray, m: int, apart: np.ndarray) -> np.ndarray:
        """|x & y| * den >= |x | y| * num, from sizes and the symmetric difference."""
        common = (n + m - apart) // 2
        return common * self.den >= (n + m - common) * self.num


def solve(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """a, b: verified links that connect what the stars connect.  ``fetch`` gives sid, hashes of the sets it is handed as sid."""

    def full(some: DataFrame) -> DataFrame:
        return some.join(fetch(some.select(F.col("b").alias("sid")).distinct()).withColumnRenamed("sid", "b"), "b")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links within a chunk; and the strays of split stars, as rows whose ``chunk`` is not null."""
        star: Star | None = None
        where: tuple[int, int, int] = (0, 0, 0)
        out: list[tuple] = []

        def close() -> None:
            if star is not None:
                star.close()
                out.extend((x, y, None, None) for x, y in star.links())
                if where[2] > 1:
                    out.extend((where[0], star.ids[u], *where[1:]) for u in star.strays())

        for batch in slices(batches, 1024, "hashes", 4 << 20):
            for a, chunk, chunks, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "chunks", "b", "hashes")), strict=True):
                got = np.frombuffer(raw, np.uint64)
                if star is None or (a, chunk) != where[:2]:
                    close()
                    star, where = Star(a, got, num, den), (a, chunk, chunks)
                if b != a:
                    star.add(b, got)
            if len(out) > 20_000:
                yield _rows(out)
                out.clear()
        close()
        if out:
            yield _rows(out)

    first = materialise(by_chunk(full(rows), inside, "a long, b long, chunk int, chunks int"), "solved")
    links, strays = first.where("chunk is null").select("a", "b"), first.where("chunk is not null")
    if not strays.limit(1).count():
        return links.distinct()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of strays with the members of the chunks they visit."""
        star: Star | None = None
        chunk0: tuple[int, int] | None = None
        out: list[tuple[int, int]] = []
        for batch in slices(batches, 1024, "hashes", 4 << 20):
            for a, chunk, visitor, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "visitor", "b", "hashes")), strict=True):
                got = np.frombuffer(raw, np.uint64)
                if chunk0 != (a, chunk):
                    star, chunk0, closed = Star(a, got, num, den), (a, chunk), False
                if not visitor:
                    if b != a:
                        star.add(b, got)
                    continue
                if not closed:
                    star.close()
                    closed = True
                if star.ids:
                    out += star.join(b, star.near(len(got), np.setxor1d(star.got, got, assume_unique=True)))
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    second = by_chunk(full(visits(rows, strays)), across, "a long, b long", "visitor")
    return links.unionByName(second).distinct()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "chunk", "chunks"])


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_key (names the row's text), n_shingles, component_id, set_links (verified links of the row's set
    with other sets that span its component), leads (whether the row is the first of its component)."""
    spark: SparkSession = df.sparkSession
    docs = id_text(df, id_col, text_col).select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    docs = docs.withColumn("ident", F.coalesce("doc_id", "text_key"))
    rows = materialise(describe(docs, k), "sets")
    # The first row of each set: rows without an identifier come last.
    order = F.struct(F.col("doc_id").isNull().alias("void"), "ident", "text_key")
    first = rows.where("sid <> 0").groupBy("sid").agg(F.min(order).alias("first"), F.first("n_shingles").alias("n_shingles"))
    met = materialise(stars(signed(docs, k, num, den)), "met")
    hists = rows.where("sid <> 0").groupBy("sid").agg(F.first("n_shingles").alias("n_shingles"), F.first("hist").alias("hist"))
    pairs = materialise(thinned(chunked(met, first), hists, num, den), "stars")
    discard(spark, met)
    wanted: list[DataFrame] = []

    def fetch(nodes: DataFrame) -> DataFrame:
        # The same plan at every size: texts are dealt by identifier and stream past the hashed list of wanted ones.
        wanted.append(materialise(first.join(nodes, "sid", "left_semi").select("sid", F.col("first.ident").alias("ident")), "wanted"))
        return full_sets(docs.select("ident", "text").join(wanted[-1].hint("shuffle_hash"), "ident").select("sid", "text"), k)

    links = materialise(solve(pairs, fetch, num, den), "set-links")
    discard(spark, pairs, *wanted)
    comp = materialise(components(links), "components")
    ends = links.select(F.col("a").alias("sid")).unionByName(links.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count(F.lit(1)).alias("set_links"))
    # The name of a component is its smallest document: of each set, then of each component.
    named = first.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("leader"))
    by_set = named.join(smallest, "root").select("sid", "leader").join(ends, "sid", "left")
    empty = F.col("sid") == 0
    return rows.join(by_set, "sid", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(empty, F.col("doc_id")).when(~F.col("leader.void"), F.col("leader.ident")).alias("component_id"),
        F.coalesce("set_links", F.lit(0)).alias("set_links"),
        (empty | (order == F.col("leader"))).alias("leads"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).drop("text_key", "leads")
