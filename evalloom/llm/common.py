"""Helpers that all training-data operators share.

Two rules hold everywhere:

* tables that cut lineage go to the folder named by ``spark.checkpoint.dir`` (shared by driver and
  executors), so a lost executor never loses them;
* Python code runs over Arrow record batches (``mapInArrow``), never row by row through pickling.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only where a local session names none (as in tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="evalloom-")
    return _LOCAL[key]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends; its result must be written, not cached."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """A 64-bit name of a text; with the identifier it names a row whose identifier others share."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    name = path.rsplit("/", 1)[1]
    _MADE[:] = [p for p in _MADE if not p.endswith(name)]


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialised frames that nothing will read again."""
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/evalloom/" in parent:
                remove(spark, parent)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end every path that ``fresh`` named within, but for those of the frames put into the yielded list."""
    before, keep = set(_MADE), []
    try:
        yield keep
    finally:
        kept = {f.split("/")[-2] for df in keep for f in df.inputFiles()}
        for path in [p for p in _MADE if p not in before and p.rsplit("/", 1)[1] not in kept]:
            remove(spark, path)


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def store(path: str):
    """The file system of a path in the shared folder, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under private names, so extra columns never clash."""
    return df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, name: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``rows`` rows and about ``most`` bytes of ``name``.

    A single long row still comes whole.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * most / max(1, batch.column(name).nbytes))))
        for i in range(0, n, step):
            yield batch.slice(i, min(step, n - i))
