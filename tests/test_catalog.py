"""Every query of the catalogue against its DuckDB equivalent."""

import math

import duckdb
import pandas as pd
import pytest

from lattica.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v

    found = [tuple(plain(v) if not hasattr(v, "item") else plain(v.item()) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
