import duckdb
import pytest

from devicelode.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()) == want
    assert want
