"""Every registered query against its SQL."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return str(v)
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(_plain(v)) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    # Whole numbers with NULLs among them are floats in the one frame.
    got = got.astype({c: "Int64" for c in want.columns if str(want[c].dtype) == "Int64"})
    assert _rows(got) == _rows(want)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["pos", "brand_name", "device_name", "device_url", "device_image", "total"]


def test_n11_categorises_every_text(spark, sf):
    got = {r["qid"]: (r["category"], r["similarity"]) for r in entry.queries()["N11_tfidf_category"](spark, sf).collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert got.keys() == {*ids, *(-1 - i for i in ids)}
    assert any(got[i] != got[-1 - i] for i in ids if i % 2)
