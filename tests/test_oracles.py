"""Every registered query against its SQL on DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from millrace.plans import queries as _filled  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if v is None or v is df or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (np.generic,)):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    return cols, sorted(([plain(v) for v in r] for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_points(spark):
    assert os.path.isdir(SF)
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
