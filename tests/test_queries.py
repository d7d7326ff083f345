"""Every registered query runs, and those with SQL agree with DuckDB."""

import os

import numpy as np
import pytest

from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return connection


def plain(frame):
    def one(v):
        if v is None or isinstance(v, float) and np.isnan(v) or v is np.nan or str(v) in ("<NA>", "NaT"):
            return "null"
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return repr(float(v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
