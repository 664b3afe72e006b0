"""Media columns: signature sniffing.

``sniff`` locates every magic byte sequence of a payload in one Aho-Corasick pass, lets a validator
per format confirm structure and lengths, corrects the declared type and lists every embedded medium
that can be carved.  ``store_samples`` writes bytes losslessly as 8-bit PCM samples of a WAVE file.

Nulls: a null payload sniffs as type null with nothing carved; a null text is the empty text.
Empty, very long and repeated payloads need no special care: each row stands alone.  Extra columns
of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import column, id_text, slices, table

# Magic bytes that a medium begins with, and its type or family.
MAGIC = [
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"OggS", "application/ogg"),
]


def _wav(b: memoryview) -> int:
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return 0
    total = 8 + struct.unpack_from("<I", b, 4)[0]
    if total > len(b):
        return 0
    at, seen = 12, set()
    while at + 8 <= total:
        name, size = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if name == b"data" and b"fmt " not in seen:
            return 0
        seen.add(name)
        at += 8 + size + (size & 1)
    return total if at == total and {b"fmt ", b"data"} <= seen else 0


def _png(b: memoryview) -> int:
    at = 8
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, at)[0], bytes(b[at + 4 : at + 8])
        end = at + 12 + size
        if end > len(b) or (at == 8 and (name != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if name == b"IEND":
            return end
        at = end
    return 0


class Gifs:
    """Where the GIFs of a payload end.  What follows a place is the same for every header before it, so
    the end of each chain of blocks and of each row of sections is remembered, and no byte is walked twice."""

    def __init__(self, b: memoryview):
        self.b = b
        self.chain = array("q", bytes(0))  # by place: the end of its chain, 0 if not known
        self.row = array("q", bytes(0))  # the end of the GIF plus 1, 1 if there is none, 0 if not known

    def _blocks(self, at: int) -> int:
        b, walked = self.b, []
        while at < len(b) and b[at] and not self.chain[at]:
            walked.append(at)
            at += 1 + b[at]
        end = (self.chain[at] if at < len(b) else 0) or at + 1
        for place in walked:
            self.chain[place] = end
        return end

    def end(self, start: int) -> int:
        """The end of a GIF that begins at ``start``, 0 if there is none."""
        b, walked, stop = self.b, [], 0
        if len(b) < start + 14:
            return 0
        if not self.row:
            self.chain, self.row = array("q", bytes(8 * len(b))), array("q", bytes(8 * len(b)))
        at = start + 13 + (3 << ((b[start + 10] & 7) + 1) if b[start + 10] & 128 else 0)
        while at < len(b):
            if self.row[at]:
                stop = self.row[at] - 1
                break
            walked.append(at)
            if b[at] == 0x3B:
                stop = at + 1
                break
            if b[at] == 0x21:
                at = self._blocks(at + 2)
            elif b[at] == 0x2C and at + 10 < len(b):
                at = self._blocks(at + 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 128 else 0))
            else:
                break
        for place in walked:
            self.row[place] = stop + 1
        return stop


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _jpeg(b: memoryview) -> int:
    at = 2
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            return 0
        mark = b[at + 1]
        if mark == 0xD9:
            return at + 2
        if at + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, at + 2)[0]
        if size < 2:
            return 0
        at += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            scan = _MARKER.search(b, at)
            if scan is None:
                return 0
            at = scan.start()
    return 0


def _gzip(b: memoryview) -> int:
    d = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(b) and not d.eof:  # in bounded steps: a bomb is never held whole
            rest = d.unconsumed_tail or bytes(b[at : at + 65536])
            at += 0 if d.unconsumed_tail else len(rest)
            d.decompress(rest, 1 << 20)
        while not d.eof and d.unconsumed_tail:
            d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0
    return at - len(d.unused_data) if d.eof else 0


def _webp(b: memoryview) -> int:
    total = 8 + struct.unpack_from("<I", b, 4)[0] if len(b) >= 20 else 0
    if not 20 <= total <= len(b) or bytes(b[12:16]) not in (b"VP8 ", b"VP8L", b"VP8X"):
        return 0
    at = 12
    while at + 8 <= total:
        size = struct.unpack_from("<I", b, at + 4)[0]
        at += 8 + size + (size & 1)
    return total if at == total else 0


def _riff(b: memoryview) -> int:
    form = bytes(b[8:12])
    return _wav(b) if form == b"WAVE" else _webp(b) if form == b"WEBP" else 0


def _ogg(b: memoryview) -> int:
    """Pages of one stream, from its first to its last by their flags, numbers and segment tables."""
    at, page, serial = 0, 0, None
    while at + 27 <= len(b) and bytes(b[at : at + 5]) == b"OggS\0":
        flags, n = b[at + 5], b[at + 26]
        mine, number = struct.unpack_from("<II", b, at + 14)
        if number != page or (serial is not None and mine != serial) or bool(flags & 2) != (page == 0) or at + 27 + n > len(b):
            return 0
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
        if flags & 4:
            return at
        page, serial = page + 1, mine
    return 0


VALIDATORS: dict[str, Callable[[memoryview], int]] = {
    "riff": _riff,
    "image/png": _png,
    "image/jpeg": _jpeg,
    "application/gzip": _gzip,
    "application/ogg": _ogg,
}
# Marks that close a medium; where it ends is looked up among them, so no payload is searched twice.
TRAILERS = [(b"%%EOF", "eof"), (b"startxref", "xref"), (b"PK\x05\x06", "eocd")]


def _pdf_end(at: int, marks: dict[str, list[int]]) -> int:
    """The first end mark after a cross-reference mark that follows ``at``; 0 if none."""
    x = bisect_right(marks["xref"], at)
    if x == len(marks["xref"]):
        return 0
    e = bisect_right(marks["eof"], marks["xref"][x])
    return marks["eof"][e] + 5 if e < len(marks["eof"]) else 0


def _zips(b: memoryview, marks: dict[str, list[int]]) -> dict[int, int]:
    """Begin and end of every archive: its end record says where its directory and thereby the archive begins."""
    out = {}
    for at in marks["eocd"]:
        if at + 22 <= len(b):
            size, offset = struct.unpack_from("<II", b, at + 12)
            end, begin = at + 22 + struct.unpack_from("<H", b, at + 20)[0], at - size - offset
            if end <= len(b) and begin >= 0 and bytes(b[begin + offset : begin + offset + 4]) in (b"PK\x01\x02", b"PK\x05\x06"):
                out[begin] = max(end, out.get(begin, 0))
    return out


class Sniffer:
    """One automaton over all magic bytes and closing marks; bytes are read as Latin-1 so that a position is a byte."""

    def __init__(self) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for magic, kind in [*MAGIC, *TRAILERS]:
            self.auto.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.auto.make_automaton()

    def spans(self, payload: bytes) -> list[tuple[str, int, int]]:
        """(type, start, end) of every confirmed medium, outermost first; what lies inside one is not listed apart."""
        marks: dict[str, list[int]] = {kind: [] for _, kind in TRAILERS}
        starts: list[tuple[int, str]] = []
        for last, (size, kind) in self.auto.iter(payload.decode("latin-1")):
            if kind in marks:
                marks[kind].append(last - size + 1)
            else:
                starts.append((last - size + 1, kind))
        view = memoryview(payload)
        zips = _zips(view, marks) if marks["eocd"] else {}
        gifs = Gifs(view)
        found, end = [], 0
        for at, kind in sorted(starts):
            if at < end:
                continue
            if kind == "application/pdf":
                stop = _pdf_end(at, marks)
            elif kind == "application/zip":
                stop = zips.get(at, 0)
            elif kind == "image/gif":
                stop = gifs.end(at)
            else:
                length = VALIDATORS[kind](view[at:])
                stop = at + length if length else 0
            if stop:
                found.append(("image/webp" if payload[at + 8 : at + 12] == b"WEBP" else "audio/wav" if kind == "riff" else kind, at, stop))
                end = stop
        return found

    def inside(self, payload: bytes, span: tuple[str, int, int]) -> list[tuple[str, int, int]]:
        """Media carved from within a confirmed one, such as a picture among samples."""
        _, at, end = span
        return [(k, at + 1 + s, at + 1 + e) for k, s, e in self.spans(payload[at + 1 : end])]


def store_samples(payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE file whose unsigned 8-bit mono samples are the payload's bytes."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def read_samples(medium: bytes) -> bytes:
    """The samples of the ``data`` chunk; ValueError where there is none."""
    at = 12
    while at + 8 <= len(medium):
        size = struct.unpack_from("<I", medium, at + 4)[0]
        if medium[at : at + 4] == b"data":
            return medium[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stored form), declared (the type a careless producer states: for about half of the texts still that of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            raw = [(t or "").encode() for t in b.column("text").to_pylist()]
            media = [store_samples(padded(r)) for r in raw]
            said = ["audio/wav" if zlib.crc32(r) % 2 else "text/plain" for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array(said, pa.string())],
                ["doc_id", "n_bytes", "media", "declared"],
            )

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


SNIFFED = "media_type string, corrected boolean, media_bytes long, media_sha256 string, carved array<struct<type:string,start:long,stop:long>>"


def sniff(df: DataFrame, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    """Sniff a binary column.

    Returns ``keep``, then media_type (confirmed at byte 0; else ``application/octet-stream``; null for
    null), corrected (differs from the declared type), media_bytes, media_sha256 and carved (type and
    byte range of every further medium).  With ``payload`` also the digests of samples read back.
    """
    n_keep = len(keep)
    src = df.select(*(column(c).alias(f"k{i}") for i, c in enumerate(keep)), column(media_col).alias("_media"), column(declared_col).alias("_declared"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n_keep]), SNIFFED])
    if payload:
        schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    fields = src.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        spans_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in slices(batches, 512, "_media"):
            rows = []
            for m, declared in zip(b.column("_media").to_pylist(), b.column("_declared").to_pylist(), strict=True):
                if m is None:
                    rows.append((None, None, None, None, []) + (None,) * (4 * payload))
                    continue
                spans = sniffer.spans(m)
                whole = spans[0] if spans and spans[0][1] == 0 else None
                inner = (sniffer.inside(m, whole) if whole else []) + (spans[1:] if whole else spans)
                kind = whole[0] if whole else "application/octet-stream"
                row = (kind, kind != declared, len(m), hashlib.sha256(m).hexdigest(), [{"type": k, "start": s, "stop": e} for k, s, e in inner])
                if payload:
                    p = read_samples(m) if kind == "audio/wav" else m
                    mean = sum(p) / len(p) if p else 0.0
                    row += (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), f"{kind};carved={len(inner)};mean={mean:.4f};peak={max(p, default=0)}")
                rows.append(row)
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), spans_type, pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = ["media_type", "corrected", "media_bytes", "media_sha256", "carved", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
            k = 9 if payload else 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), *(pa.array(list(c), t) for c, t in zip(cols[:k], kinds, strict=False))], [*fields.names[:n_keep], *names[:k]])

    return src.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def carve(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Explode ``carved`` of a frame that still holds the media into one row per embedded medium, with its bytes."""
    one = df.select("*", F.explode("carved").alias("_c"))
    return one.select("*", F.col("_c.type").alias("carved_type"), F.substring(F.col(media_col), F.col("_c.start").cast("int") + 1, (F.col("_c.stop") - F.col("_c.start")).cast("int")).alias("carved_bytes")).drop("_c")


def query(spark, sf_dir: str) -> DataFrame:
    media = encode_media(table(spark, sf_dir, "documents"))
    out = sniff(media, keep=("doc_id", "n_bytes"), payload=True)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", F.size("carved").cast("long").alias("n_carved"))
