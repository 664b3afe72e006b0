"""Every query of the engine against its SQL on the smallest tables; those without SQL must run."""

import pytest

from evalloom import catalog
from tests.compare import connect, rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small)
    if name not in SQL:
        assert got.count() > 0
        return
    pdf, want = got.toPandas(), con.sql(SQL[name]).df()
    assert sorted(pdf.columns) == sorted(want.columns)
    assert rows(pdf) == rows(want)


@pytest.mark.parametrize("name", ["dedupe_first_stem", "trim_over_quota", "chunk_batches", "near_dup_pairs"])
def test_partitions_do_not_matter(spark, small, tmp_path, name):
    """The same rows in one file or in many give the same result."""
    import os

    for table in os.listdir(small):
        spark.read.parquet(f"{small}/{table}").repartition(7).write.parquet(str(tmp_path / table))
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(QUERIES[name](spark, small).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
