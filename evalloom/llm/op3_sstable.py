"""Token-ID output as sorted-string-table shards.

Rows are range-partitioned by identifier; each task writes a shard for every ``shard_bytes`` of its rows: blocks of prefix-compressed
keys with their values, then a sparse block index (first key, place and row count of each block), a
Bloom filter over the keys and a fixed footer.  A lookup reads the footer, the Bloom filter and the
index, finds the block by binary search and scans that block alone.

File layout (little-endian)::

    block*   zstandard-compressed entries: varint shared, varint unshared, varint value size, key suffix, value
    index    per block: u16 key size, first key, u64 offset, u32 stored size, u32 rows
    bloom    u32 hashes, u64 bits, bit array
    footer   u64 index offset, u32 index size, u64 bloom offset, u32 bloom size, u32 blocks, u64 rows, u64 ids, 8 bytes magic

A key is the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is numeric
order.  Equal identifiers keep all their rows, side by side, in order of a hash of their text.  A null
identifier can't be looked up: it is stored after all others, under the largest key with a mark in its value,
and read back as null.  A null text holds the end id alone.  Extra columns are ignored.
Each task writes under a name of its own and only successful tasks reach the manifest, so retries
and lost executors leave at most unreferenced files.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import fresh, id_text, materialise, parts, slices, table
from evalloom.llm.tokens import encoder

# Fixed values of the file format.
FORMAT_MAGIC = b"EVLMSST1"
FOOTER = struct.Struct("<QIQIIQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
SHARD_BYTES = 1 << 30
_LAST = (1 << 63) - 1


def key_of(ident: int) -> bytes:
    return struct.pack(">Q", (ident + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of 64-bit keys: double hashing of a mixed key."""
    with np.errstate(over="ignore"):
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        step = (h >> np.uint64(17)) | np.uint64(1)
        return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class ShardWriter:
    """Streams entries in key order; holds one block, the index and the keys for the Bloom filter."""

    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=1)
        self.at = self.rows = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[int] = []
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.first, self.last, self.count = [], 0, b"", b"", 0

    def add(self, ident: int, value: bytes, n_ids: int) -> None:
        key = key_of(ident)
        shared = 0
        if self.count:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value)
        self.size += len(value) + 12
        self.last, self.count = key, self.count + 1
        if not self.keys or self.keys[-1] != ident:
            self.keys.append(ident)
        self.rows += 1
        self.ids += n_ids
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            stored = self.zstd.compress(b"".join(self.block))
            self.out.write(stored)
            self.index.append((self.first, self.at, len(stored), self.count))
            self.at += len(stored)
        self._open()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", at, size, n) for k, at, size, n in self.index)
        bits = max(64, (len(self.keys) * BLOOM_BITS + 7) // 8 * 8)
        bitmap = np.zeros(bits // 8, np.uint8)
        if self.keys:
            where = _bits(np.array(self.keys, np.int64).view(np.uint64), bits).ravel()
            np.bitwise_or.at(bitmap, (where >> np.uint64(3)).astype(np.int64), np.uint8(1) << (where & np.uint64(7)).astype(np.uint8))
        bloom = struct.pack("<IQ", BLOOM_HASHES, bits) + bitmap.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.index), self.rows, self.ids, FORMAT_MAGIC))
        self.out.close()


class Shard:
    """Reads a shard through any seekable file object."""

    def __init__(self, f, size: int):
        import zstandard

        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        self.index_at, index_size, self.bloom_at, bloom_size, blocks, self.rows, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != FORMAT_MAGIC:
            raise ValueError("not a sorted-string-table shard")
        raw, at = self._read(self.index_at, index_size), 0
        self.firsts, self.places = [], []
        for _ in range(blocks):
            n = struct.unpack_from("<H", raw, at)[0]
            self.firsts.append(raw[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QII", raw, at + 2 + n))
            at += 18 + n
        self.bloom_size, self.bloom = bloom_size, None

    def _read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return self.f.read(size)

    def entries(self, block: int) -> Iterator[tuple[int, bytes]]:
        at, size, rows = self.places[block]
        raw = self.zstd.decompress(self._read(at, size))
        at, key = 0, b""
        for _ in range(rows):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield ident_of(key), raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[int, bytes]]:
        for block in range(len(self.places)):
            yield from self.entries(block)

    def may_hold(self, ident: int) -> bool:
        if self.bloom is None:
            raw = self._read(self.bloom_at, self.bloom_size)
            self.bloom = (struct.unpack_from("<IQ", raw)[1], np.frombuffer(raw, np.uint8, offset=12))
        bits, bitmap = self.bloom
        where = _bits(np.array([ident], np.int64).view(np.uint64), bits)[0]
        return bool(np.all(bitmap[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & 1))

    def get(self, ident: int) -> list[bytes]:
        """All values of an identifier."""
        if not self.may_hold(ident):
            return []
        block = max(0, bisect_right(self.firsts, key_of(ident)) - 1)
        while block and self.firsts[block] == key_of(ident):  # equal keys may begin in an earlier block
            block -= 1
        out = []
        for b in range(block, len(self.places)):
            if self.firsts[b] > key_of(ident):
                break
            out += [v for k, v in self.entries(b) if k == ident]
        return out


def _filesystem(path: str):
    """Files are written and read where Spark's own shared folder is, by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def pack_ids(ids: np.ndarray, unnamed: bool = False) -> bytes:
    """Ids in 2 bytes where all fit, else in 4; the first byte tells which, and whether the identifier is null."""
    width = 2 if ids.size == 0 or ids.max() < 1 << 16 else 4
    return bytes([width | 128 * unnamed]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0] & 127}", offset=1)


def is_unnamed(value: bytes) -> bool:
    return value[0] > 127


def write_shards(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, write the shards and return the manifest (path, size, first_id, last_id, rows, ids, seq: their order), itself stored.

    Rows of one identifier, or of none, are dealt out by their text, and equal ones by where
    they were read, so a hot one is the work of many tasks.
    """
    spark = df.sparkSession
    n = shards or max(parts(spark), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, writer = encoder(tokenizer), struct.pack("<I", end_id), None
        system, where = _filesystem(folder)
        number = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows, total = writer.rows, writer.ids
            writer.close()
            size = system.get_file_info(f"{where}/{path}").size
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "size": [size], "first_id": [first], "last_id": [last], "rows": [rows], "ids": [total], "seq": [number]})

        for b in slices(batches, 512):
            texts_ = enc.encode([t or "" for t in b.column("text").to_pylist()])
            for ident, void, raw in zip(b.column("doc_id").to_pylist(), b.column("void").to_pylist(), texts_, strict=True):
                if writer is not None and writer.at > shard_bytes:
                    yield done()
                    writer = None
                if writer is None:
                    system.create_dir(where, recursive=True)
                    path, first = f"shard-{uuid.uuid4().hex}.sst", ident
                    writer = ShardWriter(system.open_output_stream(f"{where}/{path}"))
                seq = np.frombuffer(raw + end, "<u4")
                writer.add(ident, pack_ids(seq, void), len(seq))
                last = ident
        if writer is not None:
            yield done()

    named = id_text(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.col("doc_id").isNull().alias("void"), F.xxhash64("text").alias("key"), F.spark_partition_id().alias("salt"), "text")
    ordered = named.repartitionByRange(n, "doc_id", "void", "key", "salt").sortWithinPartitions("doc_id", "void", "key", "salt", F.encode("text", "utf-8"))
    manifest = ordered.mapInArrow(run, "path string, size long, first_id long, last_id long, rows long, ids long, seq long")
    return materialise(manifest, "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every entry, from the files."""
    spark = manifest.sparkSession
    # One row a shard: the running sum is over as many rows as there are files, not documents.
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                system, where = _filesystem(row["path"])
                with system.open_input_file(where) as f:
                    at, out, held = row["base"], [], 0
                    for ident, value in Shard(f, row["size"]).scan():
                        ids = unpack_ids(value)
                        out.append((None if is_unnamed(value) else ident, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        held += 4 * len(ids)
                        if held > 4 << 20:
                            yield _batch(out)
                            out, held = [], 0
                    if out:
                        yield _batch(out)

    spread = placed.select("path", "size", "base").repartition(max(parts(spark), 1), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids": pa.array(d, pa.binary())})


def _route(wanted: DataFrame, shards: list[tuple[int, int, str, int]]) -> DataFrame:
    """want, path, size of every shard of a bounded list whose key range holds the identifier."""
    shared = wanted.sparkSession.sparkContext.broadcast(sorted(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        firsts = [r[0] for r in ranges]
        for b in batches:
            rows = []
            for want in b.column("want").to_pylist():
                k = bisect_right(firsts, want) - 1
                while k >= 0 and ranges[k][1] >= want:  # ranges are in order and meet at equal identifiers only
                    rows.append((want, ranges[k][2], ranges[k][3]))
                    k -= 1
            if rows:
                x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"want": pa.array(x, pa.int64()), "path": pa.array(y), "size": pa.array(z, pa.int64())})

    return wanted.mapInArrow(run, "want long, path string, size long")


def lookup(manifest: DataFrame, idents: DataFrame, id_col: str = "doc_id", block: int = 100_000) -> DataFrame:
    """The ids of the wanted identifiers: each shard whose key range holds some is opened once; Bloom filter
    and binary search do the rest.  The manifest is sent to the tasks ``block`` shards at a time."""
    wanted = idents.select(F.col(id_col).cast("long").alias("want")).where("want is not null").distinct()
    blocks = max(1, -(-manifest.count() // block))
    ranged = None
    for k in range(blocks):
        mine = manifest.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == k).select("first_id", "last_id", "path", "size").collect()
        part = _route(wanted, [tuple(r) for r in mine])
        ranged = part if ranged is None else ranged.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                if at != row["path"]:
                    system, where = _filesystem(row["path"])
                    shard, at = Shard(system.open_input_file(where), row["size"]), row["path"]
                out += [(row["want"], 0, len(unpack_ids(v)), unpack_ids(v).astype("<u4").tobytes()) for v in shard.get(row["want"]) if not is_unnamed(v)]
            if out:
                yield _batch(out)
                out = []

    return ranged.select("want", "path", "size").repartition("path").sortWithinPartitions("path", "want").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary").drop("start")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that hold ``ids``."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), fresh(spark, "sst"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return digests(read_shards(manifest))


__all__ = ["Shard", "ShardWriter", "digests", "lookup", "query", "read_shards", "write_shards"]
