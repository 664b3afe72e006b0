"""Inverted-file index over vectors, for cosine neighbours.

Centroids are fitted at the driver on at most ``sample`` rows; every row is indexed in its nearest list.  A query probes the
nearest ``share`` of the lists, or all of them (``exact``).  Lists and the queries that probe them are cut by hash into
cells of about ``cell`` rows, so that a large list or a popular one is the work of many tasks; queries stay in tables
throughout.  Each cell keeps a query's ``k`` best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.lineage import cut
from evalloom.operators.vocab import repeated

SAMPLE = 16_384
MEMBERS = 1024
CELL = 4096


@dataclass
class Index:
    """rows: id, vector (unit length), list; centre: one row a list; size: number of rows."""

    rows: DataFrame
    centre: np.ndarray
    size: int


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of a column, one a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, vector scaled to length 1; a zero vector stays as it is, rows without a vector go."""
    v = F.col(vector).cast("array<double>")
    length = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-300))
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.transform(v, lambda x: x / length).alias("vector"))


def centroids(rows: DataFrame, n: int, sample: int = SAMPLE, members: int = MEMBERS, rounds: int = 8, seed: int = 42, lists: int | None = None) -> np.ndarray:
    """k-means over about ``sample`` rows of the smallest seeded hashes: lists of about ``members`` rows (or as many as ``lists``
    says), at most ``sample / 16`` of them.  The same rows give the same centroids, however they are partitioned."""
    lists = max(1, min(lists or -(-n // members), sample // 16))
    named = F.xxhash64(F.lit(seed), "id")
    picked = rows.where(F.pmod(named, F.lit(1 << 30)) < int(sample / max(n, 1) * (1 << 30)) + 1).orderBy(named, "id").limit(sample)
    data = matrix(picked.select("vector").toArrow().column("vector"))
    if not len(data):
        return data
    centre = data[np.random.default_rng(seed).choice(len(data), min(lists, len(data)), replace=False)].copy()
    for _ in range(rounds if len(centre) > 1 else 0):
        nearest = closest(data, centre)
        order = np.argsort(nearest, kind="stable")
        used, start = np.unique(nearest[order], return_index=True)
        centre[used] = np.add.reduceat(data[order], start) / np.diff([*start, len(data)])[:, None]
    return centre


def closest(data: np.ndarray, centre: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    found = [np.argmax(data[i : i + step] @ centre.T - half, axis=1) for i in range(0, len(data), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def build(base: DataFrame, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, members: int = MEMBERS) -> Index:
    rows = unit(base, id_col, vector)
    size = rows.count()
    centre = centroids(rows, size, sample, members)
    shared = base.sparkSession.sparkContext.broadcast(centre)  # at most sample / 16 rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(closest(matrix(b.column("vector")), shared.value), pa.int32())], ["id", "vector", "list"])

    return Index(cut(rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, vector array<double>, list int")), centre, size)


def search(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", share: float = 0.65, exact: bool = False, others: bool = True, cell: int = CELL) -> DataFrame:
    """query, neighbour, similarity, rank of the ``k`` nearest by cosine, rounded to 6 places, ties to the smaller identifier.

    ``others``: queries and rows share their identifiers, and a row is not its own neighbour.  An index of one cell whose
    lists are all probed is sent to the queries, which then are not shuffled.
    """
    asked = unit(queries, id_col, vector)
    probed = len(index.centre) if exact else max(1, round(share * len(index.centre)))
    shared = queries.sparkSession.sparkContext.broadcast(index.centre)
    of, to = dict(asked.dtypes)["id"], dict(index.rows.dtypes)["id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argsort(-(matrix(b.column("vector")) @ shared.value.T), axis=1, kind="stable")[:, :probed].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probed), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), lists], ["id", "vector", "lists"])

    def best(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``left``, identifier in ``right``, similarity; nearest first within a place."""
        out: list[list] = [[np.zeros(0, np.int64)], [], []]
        if left.num_rows and right.num_rows:
            q, x = matrix(left.column("vector")), matrix(right.column("vector"))
            q_id, x_id = left.column("id").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(x_id, kind="stable")  # a stable sort by similarity then keeps ties in order
            x, x_id = x[order], x_id[order]
            for s in range(0, len(q), 256):
                sims = np.round(q[s : s + 256] @ x.T, 6)
                if others:
                    sims[q_id[s : s + 256, None] == x_id[None, :]] = -np.inf
                for i, row in enumerate(sims):
                    most = np.partition(row, len(row) - k)[len(row) - k] if k < len(row) else -np.inf
                    at = np.flatnonzero(row >= most)
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    at = at[row[at] > -np.inf]
                    for cells, value in zip(out, (np.full(len(at), s + i), x_id[at], row[at]), strict=True):
                        cells.append(value)
        return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)

    def named(left: pa.Table, right: pa.Table, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[pa.Array]:
        return [left.column("id").combine_chunks().take(pa.array(found[0], pa.int64())), pa.array(list(found[1]), right.schema.field("id").type), pa.array(found[2], pa.float64())]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(named(left, right, best(left, right)), ["query", "neighbour", "similarity"])

    if not len(index.centre):
        return asked.limit(0).select(F.col("id").alias("query"), F.lit(None).cast(to).alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    if index.size <= cell and probed == len(index.centre):
        whole = queries.sparkSession.sparkContext.broadcast(index.rows.select("id", "vector").toArrow())  # at most ``cell`` rows

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                left = pa.Table.from_batches([b])
                found = best(left, whole.value)
                rank = np.arange(1, len(found[0]) + 1) - np.searchsorted(found[0], found[0])
                yield pa.RecordBatch.from_arrays([*named(left, whole.value, found), pa.array(rank, pa.int64())], ["query", "neighbour", "similarity", "rank"])

        found = asked.mapInArrow(nearest, f"query {of}, neighbour {to}, similarity double, rank long")
        if repeated(asked.select("id"), "id") is None:
            return found
        return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    one = asked.mapInArrow(probe, f"id {of}, vector array<double>, lists array<int>").select("id", "vector", F.explode("lists").alias("list"))
    parts = lambda df, n: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(n))
    plan = F.broadcast(parts(index.rows, "chunks").join(parts(one, "crowds"), "list"))  # a row a list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = one.join(plan, "list").select("list", dealt("crowds").alias("crowd"), every("chunks").alias("chunk"), "id", "vector")
    right = index.rows.join(plan, "list").select("list", every("crowds").alias("crowd"), dealt("chunks").alias("chunk"), "id", "vector")
    key = ["list", "crowd", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"query {of}, neighbour {to}, similarity double")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
