"""Approximate nearest neighbours by largest inner product: probed lists, scanned by adaptive numbers of dimensions.

1. ``vectors``: rows that take part, with a row number of their own, stored.
2. ``centroids`` are fitted on a bounded sample (``SAMPLE`` rows, those of the smallest hash of identifier and vector);
   a list has about ``LIST`` members, and there are at most ``SAMPLE / 16`` lists.  Every vector is indexed in its nearest list.
3. Each query scans its ``first`` nearest lists, which gives a score to beat.  Of the other lists it then probes those
   that may hold better: the members of a list lie around its centre at a known distance, so the number of them beyond
   the score to beat can be estimated; lists are left out from the least promising on, as long as they hold at most
   ``loss * k`` expected neighbours together.  Where vectors form no clusters that means most lists, where they do, few.
4. A list is scanned in cells of at most ``CELL`` members and ``CELL`` queries, dealt out by hash, so that one large
   list or one popular list is the work of many tasks.  In a cell all vectors are rotated at random, and the columns
   taken in blocks.  After each block the squared distance so far of a candidate that reaches the score to beat is a
   beta-distributed share of its squared distance; candidates whose distance so far is beyond the share's quantile
   ``1 - risk`` are abandoned.  What is left is scored on the original vectors in double precision.
5. The best ``k`` of a query are kept by cell, and the best of these by a window over the query, that limits the rows
   of each task before they are shuffled.

``exact=True`` is the exact way: all lists are probed that the Cauchy-Schwarz bound allows, and a candidate goes only if
its distance so far is too large by itself.

Defined results: vectors that are null or zero, hold null or non-finite components, or whose squares overflow take no part, nor do
rows without an identifier, nor vectors of another length than the commonest (of equally common ones, the shortest).
Rows of one identifier are rows of their own: each is a candidate for the others, and each asks if the identifier is a
query's.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.common import column, discard, materialise, parts, table

SAMPLE = 16_384
LIST = 1024
CELL = 4096
STEP = 16  # columns in a block
ROWS = 256  # queries compared at once


# ---- index


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, vector (array of double) of the rows that take part, stored."""
    src = df.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    # A null component makes the sum null, an infinite or undefined one makes it infinite or undefined.
    whole = src.where((square > 0) & (square < float("inf")))
    sized = materialise(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "vectors")
    common = sized.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return sized.where(F.size("vector") == common[0].d) if common else sized


def _matrix(column_: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, one a row."""
    if isinstance(column_, pa.ChunkedArray):
        column_ = column_.combine_chunks()
    flat = column_.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column_), -1) if len(column_) else flat.reshape(0, 0)


def centroids(rows: DataFrame, sample: int = SAMPLE, members: int = LIST, rounds: int = 8) -> np.ndarray:
    """k-means over the bounded sample, at the driver: at most ``sample`` vectors and ``sample / 16`` centroids."""
    n = rows.count()
    lists = max(1, min(-(-n // members), sample // 16))
    if lists == 1:
        # One list needs no sample: its centre may be anywhere.
        return np.zeros((1, len(rows.first().vector))) if n else np.zeros((0, 0))
    # Of equally likely rows about as many as the sample holds are sorted.
    named = F.xxhash64("vec_id", "vector")
    picked = rows.where(F.pmod(named, F.lit(1 << 30)) < int(sample / n * (1 << 30)) + 1).orderBy(named, "row").limit(sample).select("vector")
    data = _matrix(picked.toArrow().column("vector"))
    centre = data[np.random.default_rng(13).choice(len(data), min(lists, len(data)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(data, centre)
        order = np.argsort(nearest, kind="stable")
        used, start = np.unique(nearest[order], return_index=True)
        centre[used] = np.add.reduceat(data[order], start) / np.diff([*start, len(data)])[:, None]
    return centre


def _nearest(data: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([np.argmax(data[i : i + 4096] @ centre.T - half, axis=1) for i in range(0, len(data), 4096)]) if len(data) else np.zeros(0, np.int64)


def indexed(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """Every vector with its list and its squared distance from the list's centre, stored."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = _matrix(b.column("vector"))
            at = _nearest(data, shared.value)
            off = ((data - shared.value[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "vec_id", "vector")), pa.array(at, pa.int32()), pa.array(off)], ["row", "vec_id", "vector", "list", "off"])

    return materialise(rows.mapInArrow(run, "row long, vec_id long, vector array<double>, list int, off double"), "index")


# ---- which lists a query probes


def _beyond(gap: np.ndarray, spread: np.ndarray, d: int) -> np.ndarray:
    """Share of the members around a centre that lie at least ``gap`` in the query's direction, if they lie in any
    direction alike at the root-mean-square distance ``spread``."""
    z = np.divide(gap * math.sqrt(d), spread, out=np.full_like(gap, np.inf), where=spread > 0)
    z = np.where((spread <= 0) & (gap <= 0), -np.inf, z)
    return np.frompyfunc(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), 1, 1)(z).astype(float)


class Lists:
    """What every task knows of the lists: centres, members, and their distances from the centre (mean square and largest)."""

    def __init__(self, centre: np.ndarray, size: np.ndarray, spread: np.ndarray, reach: np.ndarray):
        self.centre, self.size, self.spread, self.reach = centre, size, np.sqrt(spread), np.sqrt(reach)

    def nearest(self, query: np.ndarray, first: int) -> np.ndarray:
        score = np.where(self.size > 0, query @ self.centre.T, -np.inf)
        return np.argsort(-score, axis=1, kind="stable")[:, :first].astype(np.int32)

    def others(self, query: np.ndarray, beat: np.ndarray, k: int, first: int, loss: float) -> list[np.ndarray]:
        """The lists to probe after the ``first`` nearest; ``loss`` 0 leaves out only those that hold nothing better."""
        norm = np.sqrt((query * query).sum(axis=1))[:, None]
        gap = beat[:, None] - query @ self.centre.T
        keep = (gap <= norm * self.reach * (1 + 1e-9) + 1e-12) & (self.size > 0)
        if loss:
            expected = self.size * _beyond(gap, np.broadcast_to(norm * self.spread, gap.shape), query.shape[1])
            least = np.argsort(expected, axis=1, kind="stable")
            total = np.cumsum(np.take_along_axis(expected, least, 1), axis=1)
            worth = np.empty_like(keep)
            np.put_along_axis(worth, least, total > loss * k, 1)
            keep &= worth
        np.put_along_axis(keep, self.nearest(query, first), False, 1)
        return [np.flatnonzero(x).astype(np.int32) for x in keep]


# ---- scan of a cell


@cache
def shares(d: int, step: int, risk: float, draws: int = 200_000) -> list[tuple[int, float]]:
    """After how many columns candidates are judged, and the share of a squared distance that is exceeded with chance
    ``risk`` there: quantiles of the beta distribution, by numerical integration.  Risk 0: the whole."""
    out = []
    for m in range(step, d, step):
        if not risk:
            out.append((m, 1.0))
            continue
        x = (np.arange(draws) + 0.5) / draws
        log = (m / 2 - 1) * np.log(x) + ((d - m) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append((m, float(x[min(draws - 1, np.searchsorted(mass, (1 - risk) * mass[-1]) + 1)])))
    return out


@cache
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(q: np.ndarray, q_row: np.ndarray, beat: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int, turn: np.ndarray, tests: list[tuple[int, float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position of each query that finds something, with the rows (positions) of its best ``k`` in order, and their scores.

    A candidate goes when its partial squared distance is beyond the tested share of the largest squared distance that
    reaches the score to beat, which the query's own finds raise: |q|^2 + |x|^2 - 2 score.
    """
    d = x.shape[1]
    rq, rx = q @ turn, x @ turn
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    cuts = [0, *(m for m, _ in tests)]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    beat = beat.copy()
    for lo in range(0, len(x), 2 * ROWS):
        hi = min(lo + 2 * ROWS, len(x))
        for at in range(0, len(q), ROWS):
            to = min(at + ROWS, len(q))
            most = q2[at:to, None] + x2[None, lo:hi]
            slack = 1e-9 * most
            most = most - 2 * np.where(np.isfinite(beat[at:to]), beat[at:to], -np.inf)[:, None]
            i = j = None  # all pairs of the tile, until few are left
            part = np.zeros((to - at, hi - lo))
            for (m, share), before in zip(tests, cuts, strict=False):
                a, b = rq[at:to, before:m], rx[lo:hi, before:m]
                if i is None:
                    part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
                    stay = ~(part > share * most + slack)
                    if stay.mean() < 0.2:
                        i, j = np.nonzero(stay)
                        part, limit, loose = part[i, j], most[i, j], slack[i, j]
                else:
                    part = part + ((a[i] - b[j]) ** 2).sum(axis=1)
                    stay = ~(part > share * limit + loose)
                    i, j, part, limit, loose = i[stay], j[stay], part[stay], limit[stay], loose[stay]
            if i is None:
                i, j = np.nonzero(stay if tests else np.ones((to - at, hi - lo), bool))
            mine = q_row[at + i] != x_row[lo + j]
            i, j = i[mine], j[mine]
            score = np.concatenate([np.einsum("ij,ij->i", q[at + i[s : s + 16384]], x[lo + j[s : s + 16384]]) for s in range(0, len(i), 16384)]) if len(i) else np.zeros(0)
            good = ~(score < beat[at + i])  # what the tests let pass need not reach the score to beat
            i, j, score = i[good], j[good], score[good]
            stop = np.searchsorted(i, np.arange(to - at + 1))
            for r in np.flatnonzero(np.diff(stop)).tolist():
                s, e = stop[r], stop[r + 1]
                where, found = np.concatenate([best[at + r][0], lo + j[s:e]]), np.concatenate([best[at + r][1], score[s:e]])
                top = np.lexsort((x_row[where], x_id[where], -found))[:k]
                best[at + r] = where[top], found[top]
                if len(top) == k:
                    beat[at + r] = max(beat[at + r], found[top[-1]])
    yield from ((n, w, s) for n, (w, s) in enumerate(best) if len(w))


def scanned(index: DataFrame, asked: DataFrame, k: int, d: int, risk: float) -> DataFrame:
    """query_row, query_id, vec_id, row, score: the best ``k`` that each query finds in each cell.

    ``asked`` holds query_row, query_id, vector, beat and lists.  Lists have a count each of members and queries, so
    the tables of cells are as long as the list of centroids.
    """
    one = asked.select("query_row", "query_id", "vector", "beat", F.explode("lists").alias("list"))
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    crowds = one.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("crowds"))
    plan = F.broadcast(sizes.join(crowds, "list"))  # a row a list: at most SAMPLE / 16
    of = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = one.join(plan, "list").select("list", of("query_row", "crowds").alias("crowd"), every("chunks").alias("chunk"), F.col("query_row").alias("row"), F.col("query_id").alias("id"), "vector", "beat")
    right = index.join(plan, "list").select("list", every("crowds").alias("crowd"), of("row", "chunks").alias("chunk"), "row", F.col("vec_id").alias("id"), "vector")

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if queries.num_rows and members.num_rows:
            q, x = _matrix(queries.column("vector")), _matrix(members.column("vector"))
            q_row, q_id, x_row, x_id = (t.column(c).to_numpy() for t in (queries, members) for c in ("row", "id"))
            for n, where, score in scan(q, q_row, queries.column("beat").to_numpy(), x, x_row, x_id, k, rotation(d), shares(d, STEP, risk)):
                for cell, value in zip(out, (np.full(len(where), q_row[n]), np.full(len(where), q_id[n]), x_id[where], x_row[where], score), strict=True):
                    cell.append(value)
        cells = [pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, [pa.int64()] * 4 + [pa.float64()], strict=True)]
        return pa.Table.from_arrays(cells, ["query_row", "query_id", "vec_id", "row", "score"])

    cell = ["list", "crowd", "chunk"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "query_row long, query_id long, vec_id long, row long, score double")


# ---- search


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their rank; ties go to the smaller identifier."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    first: int = 4,
    loss: float = 0.02,
    risk: float = 0.002,
    exact: bool = False,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    members: int = LIST,
) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest ``k`` of every row for which ``is_query`` (over ``vec_id``) holds."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors(df, id_col, vector_col)
    centre = centroids(rows, sample, members)
    if not len(centre):
        return spark.createDataFrame([], schema)
    d = centre.shape[1]
    index = indexed(rows, centre)
    discard(spark, rows)
    if exact:
        loss = risk = 0.0
    # A row a list.
    stats = {r.list: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.avg("off").alias("spread"), F.max("off").alias("reach")).collect()}
    shared = spark.sparkContext.broadcast(Lists(centre, *(np.array([float(getattr(stats[i], c)) if i in stats else 0.0 for i in range(len(centre))]) for c in ("n", "spread", "reach"))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _asked(b, np.full(b.num_rows, -np.inf), list(shared.value.nearest(_matrix(b.column("vector")), first)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            beat = b.column("beat").to_numpy(zero_copy_only=False)
            yield _asked(b, beat, shared.value.others(_matrix(b.column("vector")), beat, k, first, loss))

    asks = index.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "vector")
    spread_out = asks.repartition(max(parts(spark), 1), "query_row")
    kind = "query_row long, query_id long, vector array<double>, beat double, lists array<int>"
    near = materialise(ranked(scanned(index, spread_out.mapInArrow(nearest, kind), k, d, risk), k).drop("rank"), "near")
    if len(centre) <= first:
        return ranked(near, k).select("query_id", "rank", "vec_id", "score")
    beats = near.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score")).alias("beat"))
    left = asks.join(beats, "query_row", "left").select("query_row", "query_id", "vector", F.coalesce("beat", F.lit(float("-inf"))).alias("beat"))
    far = scanned(index, left.mapInArrow(others, kind), k, d, risk)
    return ranked(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")


def _asked(b: pa.RecordBatch, beat: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query_row", "query_id", "vector")), pa.array(beat), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["query_row", "query_id", "vector", "beat", "lists"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


__all__ = ["neighbours", "query", "ranked", "scan", "shares"]
