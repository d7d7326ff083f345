"""The queries that have SQL agree with DuckDB, with all odd rows that their tables can hold."""

import pytest

pytest.importorskip("public_tokenizers")
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


def plain(frame):
    def one(v):
        if v is None or v != v or str(v) == "<NA>":
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        connection.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    want = connection.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert plain(got) == plain(want) and len(got) > 0


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
