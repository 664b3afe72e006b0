"""Packing: vector bin packing by the dot-product heuristic.

An example has three sizes: tokens, segments (one for each piece) and loss-bearing tokens.  A
sequence has a limit on each.  An open sequence takes, among the waiting pieces that fit under all
limits, the one whose size vector has the largest dot product with the room that is left (both as
shares of the limits).  Where nothing fits and cutting is allowed, a piece is cut to fill the tokens
that are left.

``pack_turns`` packs instruction data: only the tokens of the turns of some roles bear loss.  ``pack`` packs
plain documents, all of whose tokens do.

Every partition is packed alone, from a bounded window of waiting pieces, so no rows are shuffled
and memory does not grow with the data; each partition leaves at most one sequence that is not
full.  A sequence's id is the partition number times 2^33 plus its rank there.

Nulls: a null text is empty and yields its end id alone; a null identifier is carried through.
Texts longer than a sequence are cut into full sequences first.  Repeated rows are packed as often
as they occur.  Of waiting pieces with equal products the one that came first goes in.  Empty tables give no
rows.  Only the named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import column, id_text, parts, slices, table
from evalloom.llm.tokens import encoder

WINDOW = 256


class Packer:
    """One open sequence and a window of waiting pieces.

    A piece is [owner, start, ids, loss flags or None]; ``emit`` is called as emit(owner, start, ids,
    sequence, offset).
    """

    def __init__(self, emit, tokens: int = 2048, segments: int = 64, loss: int | None = None, cut: bool = True, window: int = WINDOW):
        self.emit, self.cap = emit, np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.cut, self.window = tokens, cut, window
        self.loss_cap = loss or tokens
        self.wait: list[list] = []
        self.size = np.zeros((0, 3))
        self.sequence = 0
        self._open()

    def _open(self) -> None:
        self.room = self.cap.copy()
        self.offset = 0

    def _vector(self, piece: list) -> list[float]:
        return [len(piece[2]), 1, float(len(piece[2]) if piece[3] is None else np.count_nonzero(piece[3]))]

    def add(self, owner, start: int, ids: np.ndarray, flags: np.ndarray | None = None) -> None:
        """Queue an example; pack as soon as the window is full."""
        while len(ids):
            n = len(ids) if not self.cut else min(len(ids), self.tokens)
            if n > self.tokens or (not self.cut and self._vector([0, 0, ids, flags])[2] > self.loss_cap):
                raise ValueError("an example exceeds a limit and may not be cut")
            self.wait.append([owner, start, ids[:n], None if flags is None else flags[:n]])
            start, ids, flags = start + n, ids[n:], None if flags is None else flags[n:]
        if len(self.wait) >= 2 * self.window:
            self._pack(self.window)

    def close(self) -> None:
        self._pack(0)
        if self.offset:
            self.sequence += 1
            self._open()

    def _put(self, piece: list, vector: np.ndarray) -> None:
        self.emit(piece[0], piece[1], piece[2], self.sequence, self.offset)
        self.offset += len(piece[2])
        self.room -= vector

    def _pack(self, leave: int) -> None:
        wait = self.wait
        size = np.array([self._vector(p) for p in wait]).reshape(-1, 3)
        share = size / self.cap
        live = np.ones(len(wait), bool)
        left = len(wait)
        while left > leave:
            fits = live & (size <= self.room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, share @ (self.room / self.cap), -1.0)))
                self._put(wait[k], size[k])
                live[k] = False
                left -= 1
            elif self.cut and self.room.min() >= 1:
                k = int(np.argmax(np.where(live, size[:, 0], -1.0)))
                n = self._prefix(wait[k])
                head = [wait[k][0], wait[k][1], wait[k][2][:n], None if wait[k][3] is None else wait[k][3][:n]]
                self._put(head, np.array(self._vector(head)))
                wait[k] = [wait[k][0], wait[k][1] + n, wait[k][2][n:], None if wait[k][3] is None else wait[k][3][n:]]
                size[k] = self._vector(wait[k])
                share[k] = size[k] / self.cap
            else:
                self._full()
            if self.room[0] < 1:
                self._full()
        self.wait = [p for p, a in zip(wait, live, strict=True) if a]

    def _prefix(self, piece: list) -> int:
        """Tokens of a piece that fit into the room that is left; at least one."""
        n = int(min(self.room[0], len(piece[2])))
        if piece[3] is not None:
            n = min(n, int(np.searchsorted(np.cumsum(piece[3]), self.room[2], "right")))
        return max(n, 1)

    def _full(self) -> None:
        self.sequence += 1
        self._open()


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, tokenizer: str, end_id: int, tokens: int = 2048, segments: int | None = None, loss: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    All tokens of plain documents bear loss.  Unless ``segments`` says otherwise a sequence takes as many pieces
    as it has tokens, so that very short documents fill it too.
    """
    segments = segments or tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        enc, end, out, held = encoder(tokenizer), struct.pack("<I", end_id), [], [0]

        def emit(owner, start, ids, sequence, offset):
            out.append((owner[0], start, len(ids), ids.tobytes(), owner[1], base + sequence, offset))
            held[0] += 4 * len(ids)

        packer = Packer(emit, tokens, segments, loss)
        for b in slices(batches, 256):
            for ident, raw in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                packer.add((ident, len(ids)), 0, ids)
                if held[0] > 4 << 20:
                    yield _batch(out, PIECES)
                    out.clear()
                    held[0] = 0
        packer.close()
        if out:
            yield _batch(out, PIECES)

    return id_text(df, id_col, text_col).mapInArrow(run, PIECES)


TURNS = "conv_id long, turn long, start long, length long, ids binary, loss_tokens long, sequence_id long, offset long"


def pack_turns(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    tokens: int = 2048,
    segments: int = 64,
    loss: int | None = None,
    bearing: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Instruction data under limits on tokens, segments and loss-bearing tokens: conv_id, turn, start (the turn's ids
    before the piece), length, ids, loss_tokens, sequence_id, offset of every piece of a turn.

    Turns are ordered by conversation and turn; neighbouring turns of a conversation in a task make one
    example of at most ``tokens`` ids, each turn ending with ``end_id``.  A conversation that holds most of the
    table is spread over tasks by its turns.  Turns of other roles than ``bearing`` (null too) bear no loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        enc, end, out, held = encoder(tokenizer), np.array([end_id], "<u4"), [], [0]

        def emit(owner, start, ids, sequence, offset):
            stop = start + len(ids)
            for conv, turn, begin, size, bears, skipped in owner:
                a, b = max(start, begin), min(stop, begin + size)
                if a < b:
                    out.append((conv, turn, a - begin + skipped, b - a, ids[a - start : b - start].tobytes(), (b - a) * bears, base + sequence, offset + a - start))
                    held[0] += 4 * (b - a)

        packer = Packer(emit, tokens, segments, loss)
        owner: list[tuple] = []
        parts_: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        size = 0

        def example() -> None:
            nonlocal owner, size
            if size:
                packer.add(owner, 0, np.concatenate(parts_), np.concatenate(flags))
            owner, size = [], 0
            parts_.clear()
            flags.clear()

        for b in slices(batches, 256):
            raws = enc.encode([t or "" for t in b.column("text").to_pylist()])
            for conv, turn, role, raw in zip(b.column("conv").to_pylist(), b.column("turn").to_pylist(), b.column("role").to_pylist(), raws, strict=True):
                ids, bears, skipped = np.append(np.frombuffer(raw, "<u4"), end), role in bearing, 0
                if owner and owner[-1][0] != conv:
                    example()
                while len(ids):
                    n = min(len(ids), tokens - size)
                    owner.append((conv, turn, size, n, bears, skipped))
                    parts_.append(ids[:n])
                    flags.append(np.full(n, bears))
                    size, skipped, ids = size + n, skipped + n, ids[n:]
                    if size == tokens:
                        example()
                if held[0] > 4 << 20:
                    yield _batch(out, TURNS)
                    out.clear()
                    held[0] = 0
        example()
        packer.close()
        if out:
            yield _batch(out, TURNS)

    src = df.select(column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), column(role_col).alias("role"), column(text_col).alias("text"))
    return src.repartitionByRange(parts(df.sparkSession), "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, TURNS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1))


__all__ = ["Packer", "digests", "pack", "pack_turns", "query"]
