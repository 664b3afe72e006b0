"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every n-gram of an item is a seed, so any copy that keeps ``n`` unbroken words of an item holds a seed,
   whatever other copies the corpus has and however frequent the passage is.
2. Documents are searched for seeds; around the hits, on their diagonals, the item is aligned with the
   document by Smith-Waterman over words, unless too few of the item's words stand there at all.
   A pair is contaminated if the equal words of the alignment make up ``coverage`` of the item.

Test items go in blocks of bounded size (``block_bytes``), each sent to all executors; however large
the benchmark, no more than one block is held.  With several blocks the corpus is still read once: a bit
table of the seeds of all blocks, of bounded size, leaves the documents that may hold a seed, and only these
are stored and searched block by block.  Documents are never shuffled.

Every n-gram of an item is a seed, not its rarest ones alone: a rare one may be the very one that an edit
removed.  What is rare decides the cost instead: a seed's hits are only aligned where enough of the item's
words stand around them.

Defined results: items without words match nothing; items shorter than an n-gram match as a whole
sequence of words, those of one or two words only a document that has no others; null texts have no words.
Repeated documents or items yield a row each, with the best alignment of each row of documents.  Ties go to the
higher score, then to the earlier place.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import shingles
from evalloom.llm.common import column, id_text, materialise, slices, table, text_key

N, COVERAGE = 5, 0.5
BLOCK_BYTES = 8 << 20
#: Bits of the table of seeds, a seed and at most.
SEED_BITS, MOST_BITS = 16, 1 << 29
_MASK = np.uint64((1 << 20) - 1)
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased text in which ASCII punctuation is space, so edits to it do not count."""
    return (text or "").lower().encode().translate(_PLAIN)


def align(item: np.ndarray, doc: np.ndarray, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, equal words, start and end in ``doc``.

    Rows are items' words; a gap along the document is a running maximum, so each row is vectorised.  Two rows of
    scores are kept, and two bits a cell that say where its score came from.
    """
    m, n = len(item), len(doc)
    above, ramp = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32) * -gap
    best, place, came = 0, (0, 0), []
    for i in range(1, m + 1):
        across = above[:-1] + np.where(doc == item[i - 1], 1, mismatch)
        down = above[1:] + gap
        row = np.zeros(n + 1, np.int32)
        np.maximum(across, down, out=row[1:])
        np.maximum(row, 0, out=row)
        np.subtract(np.maximum.accumulate(row + ramp), ramp, out=row)
        came.append((np.packbits(row[1:] == across), np.packbits(row[1:] == down)))
        j = int(row.argmax())
        if row[j] > best:
            best, place = int(row[j]), (i, j)
        above = row
    (i, j), score, equal = place, best, 0
    end = j
    while i and j and score > 0:
        at, bit = divmod(j - 1, 8)
        if came[i - 1][0][at] >> (7 - bit) & 1:
            same = doc[j - 1] == item[i - 1]
            equal += bool(same)
            score -= 1 if same else mismatch
            i, j = i - 1, j - 1
        elif came[i - 1][1][at] >> (7 - bit) & 1:
            score -= gap
            i -= 1
        else:
            score -= gap
            j -= 1
    return best, equal, j, end


class Items:
    """The words and n-grams of a block of test items."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n, self.ids = n, [r[0] for r in rows]
        word, at = shingles.words([plain(r[1]) for r in rows])
        self.words = [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})

    def grams(self, w: np.ndarray) -> np.ndarray:
        return shingles.grams(w, min(self.n, len(w))) if len(w) else np.zeros(0, np.uint64)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-grams, where each one's places begin, and the item and position of each place."""
        grams = [self.grams(w) for w in self.words]
        sizes = np.array([len(g) for g in grams], np.int64)
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        keys, begins = np.unique(every[order], return_index=True)
        item = np.repeat(np.arange(len(grams)), sizes)
        position = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return keys, np.append(begins, len(every)), item[order], position[order]


class Finder:
    """Positions in documents of any of a set of n-grams: a bit table first, then binary search."""

    def __init__(self, wanted: np.ndarray, sizes: list[int]):
        self.wanted, self.sizes = np.sort(wanted), sizes
        self.bits = np.zeros(int(_MASK) + 1, bool)
        self.bits[(wanted & _MASK).astype(np.int64)] = True

    def __call__(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indices into ``wanted``), by n-gram size."""
        where, which = [], []
        for n in self.sizes:
            g = shingles.grams(word, n)
            p = np.flatnonzero(self.bits[(g & _MASK).astype(np.int64)])
            k = np.searchsorted(self.wanted, g[p])
            hit = k < len(self.wanted)
            hit[hit] = self.wanted[k[hit]] == g[p][hit]
            where.append(p[hit])
            which.append(k[hit])
        return np.concatenate(where), np.concatenate(which)


def _block(docs: DataFrame, rows: list[tuple[int, str]], n: int, coverage: float) -> DataFrame | None:
    if not Items(rows, n).sizes:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_ = Items(shared.value, n)
        keys, starts, of, at_word = items_.seeds()
        find = Finder(keys, items_.sizes)
        for b in slices(batches, 512, most=2 << 20):
            word, at = shingles.words([plain(t) for t in b.column("text").to_pylist()])
            marked = np.insert(word, at[1:-1], np.uint64(0))  # no n-gram crosses documents
            begins = at[:-1] + np.arange(len(at) - 1)
            where, which = find(marked)
            if not len(where):
                continue
            owner = np.searchsorted(begins, where, "right") - 1
            out = []
            ids, keys_of = b.column("doc_id"), b.column("text_key")
            for d, item, diagonals in _pairs(owner, where - begins[owner], which, starts, of, at_word):
                doc, target = word[at[d] : at[d + 1]], items_.words[item]
                if len(target) < 3 and len(doc) > len(target):
                    continue
                best = max(_aligned(target, doc, diagonals, coverage * len(target)), key=lambda x: (x[1], x[0], -x[2]), default=None)
                if best and best[1] >= coverage * len(target):
                    out.append((ids[d].as_py(), items_.ids[item], best[1] / len(target), best[0], best[1], best[2], best[3], keys_of[d].as_py()))
            if out:
                cols = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "score", "matched", "word_start", "word_end", "text_key"])

    return docs.mapInArrow(run, SCHEMA)


def _pairs(owner: np.ndarray, place: np.ndarray, which: np.ndarray, starts: np.ndarray, of: np.ndarray, at_word: np.ndarray, piece: int = 1 << 20) -> Iterator[tuple[int, int, list[int]]]:
    """Document, item and sorted diagonals of the hits, one pair at a time.

    A seed that repeats in a document and in an item gives a hit for every two places, but no more diagonals than both
    have words: about ``piece`` hits are written out at a time, and only their distinct diagonals stay.
    """
    order = np.argsort(owner, kind="stable")
    owner, place, which = owner[order], place[order], which[order]
    many = starts[which + 1] - starts[which]
    total = np.cumsum(many)
    kept: list[np.ndarray] = []  # of the last document so far, and its number
    last, begin = -1, 0
    while begin < len(owner):
        end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + piece, "right")), begin + 1)
        m = many[begin:end]
        k = np.repeat(starts[which[begin:end]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        doc, where = np.repeat(owner[begin:end], m), np.repeat(place[begin:end], m) - at_word[k]
        key = of[k].astype(np.int64) << 32 | (where + (1 << 31))
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
            if doc[x] != last:
                yield from _diagonals(last, kept)
                last, kept = int(doc[x]), []
            kept = [np.unique(np.concatenate([*kept, key[x:y]]))]
        begin = end
    yield from _diagonals(last, kept)


def _diagonals(doc: int, kept: list[np.ndarray]) -> Iterator[tuple[int, int, list[int]]]:
    for key in kept:
        item, diagonal = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
        edges = np.flatnonzero(np.diff(item)) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            yield doc, int(item[x]), diagonal[x:y].tolist()


def _aligned(item: np.ndarray, doc: np.ndarray, diagonals: list[int], least: float) -> Iterator[tuple[int, int, int, int]]:
    """Alignments of an item with each stretch of the document that its diagonals point at and that holds ``least`` of its words."""
    pad = len(item) // 2 + 4
    spans: list[list[int]] = []
    for d in diagonals:
        a, b = max(0, d - pad), min(len(doc), d + len(item) + pad)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        if np.isin(item, doc[a:b]).sum() < least:  # each word of the item is equal to one of the stretch at most
            continue
        step = 64 * len(item) + 4096
        while a < b:  # long stretches go in overlapping pieces, so the table stays small
            end = min(b, a + step)
            score, equal, s, e = align(item, doc[a:end])
            yield score, equal, a + s, a + e
            if end == b:
                break
            a = end - 3 * len(item)


SCHEMA = "doc_id long, item_id long, coverage double, score long, matched long, word_start long, word_end long, text_key long"


def _may_hold(docs: DataFrame, blocks: list[list[tuple[int, str]]] | Iterator[list[tuple[int, str]]], n: int, total: int) -> DataFrame:
    """The documents that may hold a seed of any block, by one bit table of about ``SEED_BITS`` a seed."""
    size = 1 << min(MOST_BITS, max(1 << 10, SEED_BITS * total // 6)).bit_length() - 1
    bits, sizes = np.zeros(size // 8 + 1, np.uint8), set()
    for rows in blocks:
        items = Items(rows, n)
        keys = items.seeds()[0] & np.uint64(size - 1)
        np.bitwise_or.at(bits, (keys >> np.uint64(3)).astype(np.int64), np.uint8(1) << (keys & np.uint64(7)).astype(np.uint8))
        sizes.update(items.sizes)
    shared, sizes = docs.sparkSession.sparkContext.broadcast(bits), sorted(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in slices(batches, 512, most=2 << 20):
            word, at = shingles.words([plain(t) for t in b.column("text").to_pylist()])
            marked = np.insert(word, at[1:-1], np.uint64(0))
            begins = at[:-1] + np.arange(len(at) - 1)
            hit = np.zeros(b.num_rows, bool)
            for k in sizes:
                g = shingles.grams(marked, k) & np.uint64(size - 1)
                p = np.flatnonzero(table_[(g >> np.uint64(3)).astype(np.int64)] >> (g & np.uint64(7)).astype(np.uint8) & 1)
                hit[np.searchsorted(begins, p, "right") - 1] = True
            if hit.any():
                yield b.filter(pa.array(hit))

    return materialise(docs.mapInArrow(run, docs.schema), "may-hold")


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each contaminated pair of a document and a test item, with its best alignment.

    ``text_key`` names the document's text, for rows whose identifiers others share.
    """
    docs = id_text(df, id_col, text_col).withColumn("text_key", text_key(F.col("text")))
    tests = benchmark.select(column(item_col).cast("long").alias("item_id"), column(item_text).alias("text")).where("item_id is not null and text is not null")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // block_bytes))

    def block(k: int) -> list[tuple[int, str]]:
        return sorted((r.item_id, r.text) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())

    if blocks > 1:
        docs = _may_hold(docs, map(block, range(blocks)), n, total)
    found = [part for k in range(blocks) if (part := _block(docs, block(k), n, coverage)) is not None]
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
