"""Every query of the reference's own operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import entroflow.plans.exchange_queries  # noqa: F401
import entroflow.plans.log_queries  # noqa: F401
import entroflow.plans.more_queries  # noqa: F401
import entroflow.plans.result_queries  # noqa: F401
from entroflow.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_same_as_sql(spark, duck, sf_dir, name):
    columns, rows = table(QUERIES[name](spark, sf_dir).toPandas())
    want_columns, want = table(duck.execute(ORACLES[name]).df())
    assert columns == want_columns
    assert len(rows) == len(want) and len(rows) > 0
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) <= 2e-5 * max(1, abs(float(y))), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
