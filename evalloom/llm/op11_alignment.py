"""Alignment of two tokenizers over the bytes of a text, with corpus-wide counts of aligned id pairs.

A (byte-level BPE) encodes a space and the text, B (sentencepiece, which puts that space itself) the text.
Where a token of A and one of B end at the same byte, the text is cut into groups, and the two tokens are linked.

1. ``aligned`` (no shuffle): per document its counts, the digest of its groups, and its links as distinct keys
   ``B id << 32 | A id`` with their numbers.  Texts are cut before white space that begins with a space or line feed, where
   neither vocabulary has a token that crosses, and each distinct chunk is aligned once and kept in a bounded memo.
2. ``count_shards``: ``np.unique`` sums the keys of a partition, a range partition by key sorts them globally, equal
   neighbours are summed, and every task writes its range as one file: sorted keys, then their counts.  Ranges never
   part a key; what a frequent key sends is one row a map task.
3. ``looked_up`` (no shuffle): the shards are memory-mapped and searched for a batch's distinct keys.

The highest count of each B id comes with the manifest of the shards: at most one entry a piece of B's vocabulary and
shard, whatever the corpus.  Files lie in the shared folder under names of their own and only those of the stored
manifest are read, so a task that runs twice changes nothing.

Defined results: texts that are null or empty, or whose tokens do not spell space + text (U+2581 in the text, say),
have zeros and an empty digest.  Rows are judged one by one, so repeated rows and null identifiers come back as
often as they are there.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from evalloom.llm.common import fresh, id_text, materialise, parts, slices, store, table

SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n])").split
_ONE = (1 << 32) - 1
LONG = 256  # longer chunks are not kept
_PAIRS: dict[tuple, Pair] = {}


def byte_symbols() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both vocabularies of a worker process, and the memo of aligned chunks in two generations of about ``most``."""

    def __init__(self, a_path: str, b_path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._byte_level()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(1 + max(self.a_bytes))])
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        self.a_text, self.b_text = list(map(str, range(len(self.a_sizes)))), list(map(str, range(len(pieces))))
        self.lone = pieces.index(SPACE)
        #: Chunks may be cut only if no piece has a space after something else, or a line feed.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        self.most, self.memo, self.old = most, {}, {}

    def _byte_level(self) -> dict[int, bytes]:
        symbols = byte_symbols()
        return {i: bytes(map(symbols.__getitem__, t)) if set(t) <= symbols.keys() else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}

    def _a_ids(self, chunks: list[str]) -> list[int]:
        """Ids of all chunks in a row.  Chunks that do not end with white space are encoded many at a time, as they were cut."""
        texts, row = [], []
        for c in chunks:
            row.append(c)
            if c[-1].isspace() or len(row) == 256:
                texts.append("".join(row[:-1]) if c[-1].isspace() else "".join(row))
                texts += [c] if c[-1].isspace() else []
                row = []
        texts.append("".join(row))
        return [i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids]

    def _b_ids(self, chunks: list[str]) -> list[int]:
        """B puts a space before what it gets; before a line feed that is a piece of its own."""
        found = self.b.encode([c[c[0] == " " :] for c in chunks], num_threads=1)
        return [i for c, y in zip(chunks, found, strict=True) for i in ([self.lone] if c == " " else y[1:] if c[0] == "\n" else y)]

    def _fresh(self, chunks: list[str]) -> list[tuple[int, str, bytes] | None]:
        """Of each chunk A's number of tokens with B's in the upper half, the groups as text, the keys of the links;
        None if bytes are lost.  A chunk begins with a space or a line feed."""
        stops = np.cumsum([len(c.encode()) for c in chunks])
        a, b = self._a_ids(chunks), self._b_ids(chunks)
        raw = "".join(chunks).encode()
        lost = b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw
        a_id, b_id = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_id]), np.cumsum(self.b_sizes[b_id])
        ends, last_a, last_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        # Every chunk ends where tokens of both end, so the groups of the batch are those of its chunks in a row.
        if lost or not np.isin(stops, ends).all():
            return [None] if len(chunks) == 1 else [self._fresh([c])[0] for c in chunks]
        keys = (b_id[last_b] << 32 | a_id[last_a]).astype("<i8").tobytes()
        a_text, b_text, groups = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b)), []
        i = j = 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(f"{a_text[i] if x == i + 1 else ','.join(a_text[i:x])}|{b_text[j] if y == j + 1 else ','.join(b_text[j:y])}")
            i, j = x, y
        tokens = [np.diff(np.searchsorted(e, stops, "right"), prepend=0) for e in (a_ends, b_ends)]
        cuts = (np.searchsorted(ends, stops) + 1).tolist()
        sizes = (tokens[0] | tokens[1] << 32).tolist()
        return [(n, ";".join(groups[p:q]), keys[8 * p : 8 * q]) for n, p, q in zip(sizes, [0, *cuts], cuts, strict=False)]

    def _learn(self, chunks: set[str]) -> None:
        memo, old, new = self.memo, self.old, []
        for c in chunks:
            if c in old:
                memo[c] = old[c]
            else:
                new.append(c)
        if new:
            memo.update(zip(new, self._fresh(new), strict=True))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """n_a, n_b, digest of the groups, keys of all links of each text."""
        cut = [[] if not t else _CUT(" " + t) if self.cuts and SPACE not in t else [" " + t] for t in texts]
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        if new := {c for chunks in cut for c in chunks if c not in self.memo}:
            self._learn(new)
        out = [self._joined(chunks) for chunks in cut]
        for c in new:
            if len(c) > LONG:
                del self.memo[c]
        return out

    def _joined(self, chunks: list[str]) -> tuple[int, int, str, np.ndarray]:
        got = list(map(self.memo.__getitem__, chunks))
        if None in got:
            got = self._fresh(["".join(chunks)])
        if not got or got[0] is None:
            return 0, 0, "", np.zeros(0, "<i8")
        sizes, groups, keys = zip(*got, strict=True)
        n = sum(sizes)
        return n & _ONE, n >> 32, hashlib.sha256(";".join(groups).encode()).hexdigest(), np.frombuffer(b"".join(keys), "<i8")


def pair(a_path: str, b_path: str) -> Pair:
    """One per worker process and pair of vocabularies."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, numbers binary"


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and links (distinct keys in order as 64-bit, their numbers as 32-bit integers) of every row; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for b in slices(batches, 512, most=2 << 20):
            out: list[tuple] = []
            for ident, (n_a, n_b, digest, keys) in zip(b.column("doc_id").to_pylist(), both.align(b.column("text").to_pylist()), strict=True):
                distinct, numbers = np.unique(keys, return_counts=True)
                out.append((ident, n_a, n_b, len(keys), len(keys), digest, distinct.tobytes(), numbers.astype("<i4").tobytes()))
            yield _batch(out, ALIGNED)

    return materialise(id_text(df, id_col, text_col).mapInArrow(run, ALIGNED), "aligned")


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cells = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cells, kinds, strict=True)], list(names))


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(numbers, first) if len(first) else numbers


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8")
    return keys, np.frombuffer(b"".join(batch.column("numbers").to_pylist()), "<i4").astype("<i8")


def partial_counts(links: DataFrame, most: int = 2_000_000) -> DataFrame:
    """key, n: what each partition counts; a partition with more than ``most`` distinct keys gives several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, waiting, size = np.zeros(0, "<i8"), np.zeros(0, "<i8"), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([numbers, *(n for _, n in waiting)]))

        for batch in slices(batches, name="keys"):
            waiting.append(_links(batch))
            size += len(waiting[-1][0])
            if size > max(most // 2, len(keys)):
                keys, numbers = merged()
                waiting, size = [], 0
                if len(keys) > most:
                    yield from _pairs(keys, numbers)
                    keys = numbers = np.zeros(0, "<i8")
        yield from _pairs(*merged())

    return links.select("keys", "numbers").mapInArrow(run, "key long, n long")


def _pairs(keys: np.ndarray, numbers: np.ndarray, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows]), pa.array(numbers[i : i + rows])], ["key", "n"])


MANIFEST = "path string, size long, first_key long, last_key long, b_ids binary, b_best binary"


def count_shards(partial: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """Write the counts as files of sorted keys and their sums; the stored manifest has a row a file, with the
    highest count of each B id in it."""
    n = shards or max(parts(partial.sparkSession), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = [], []
        for b in batches:  # in order: equal keys are neighbours
            k, m = summed(b.column("key").to_numpy(), b.column("n").to_numpy())
            if keys and len(k) and keys[-1][-1] == k[0]:
                numbers[-1][-1] += m[0]
                k, m = k[1:], m[1:]
            if len(k):
                keys.append(k)
                numbers.append(m.copy())
        if not keys:
            return
        key, number = np.concatenate(keys), np.concatenate(numbers)
        system, where = store(folder)
        system.create_dir(where, recursive=True)
        name = f"counts-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{where}/{name}") as f:
            f.write(key.astype("<i8").data)
            f.write(number.astype("<i8").data)
        owner = key >> 32
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        yield _batch([(f"{folder}/{name}", len(key), int(key[0]), int(key[-1]), owner[first].astype("<i8").tobytes(), np.maximum.reduceat(number, first).astype("<i8").tobytes())], MANIFEST)

    ordered = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    return materialise(ordered.mapInArrow(run, MANIFEST), "counts-manifest")


def mapped(path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard: memory-mapped where the store is a file system, else read."""
    system, where = store(path)
    if isinstance(system, fs.LocalFileSystem):
        both = np.memmap(where, "<i8", "r", shape=(2, size))
    else:
        with system.open_input_file(where) as f:
            both = np.frombuffer(f.read(), "<i8").reshape(2, size)
    return both[0], both[1]


def counts_of(keys: np.ndarray, shards: list[tuple[str, int, int, int]]) -> np.ndarray:
    """The corpus-wide count of each of the distinct sorted keys; ``shards`` in order of their ranges."""
    out = np.zeros(len(keys), np.int64)
    for path, size, first, last in shards:
        a, b = np.searchsorted(keys, [first, last + 1])
        if a < b:
            known, count = mapped(path, size)
            at = np.minimum(np.searchsorted(known, keys[a:b]), size - 1)
            out[a:b] = np.where(known[at] == keys[a:b], count[at], 0)
    return out


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The result: each row's links with their corpus-wide counts."""
    spark = rows.sparkSession
    files = manifest.orderBy("first_key").collect()  # one row a shard
    best = np.zeros(1 + max((int(np.frombuffer(f.b_ids, "<i8")[-1]) for f in files), default=0), np.int64)
    for f in files:
        np.maximum.at(best, np.frombuffer(f.b_ids, "<i8"), np.frombuffer(f.b_best, "<i8"))
    shared = spark.sparkContext.broadcast(([tuple(f[:4]) for f in files], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, best = shared.value
        for b in slices(batches, 4096, name="keys"):
            keys, numbers = _links(b)
            distinct, back = np.unique(keys, return_inverse=True)
            count = counts_of(distinct, shards)[back]
            ends = np.cumsum([len(k) // 8 for k in b.column("keys").to_pylist()])
            at = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            tops = numbers * (count == best[keys >> 32]) if len(keys) else numbers
            cells = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(at(tops)), pa.array(at(numbers * count)), b.column("groups_sha256")], [x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = aligned(df, a_path, b_path, id_col, text_col)
    return looked_up(rows, count_shards(partial_counts(rows), fresh(df.sparkSession, "counts"), shards))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


__all__ = ["Pair", "align_tokenizers", "aligned", "count_shards", "looked_up", "partial_counts", "query"]
