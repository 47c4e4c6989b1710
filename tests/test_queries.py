"""Every query with SQL equals DuckDB's result on the smallest tables; the others return rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from motionloom.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"logreg_cv", "svm_cv", "forest_cv", "rnn_cv"}


def canonical(df):
    cols = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number, np.bool_)) else v
    return cols, sorted(str([plain(v) for v in r]) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, con, name):
    assert canonical(catalog.queries()[name](spark, SF).toPandas()) == canonical(con.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(SLOW))
def test_models(spark, name):
    df = catalog.queries()[name](spark, SF).toPandas()
    assert len(df) and df["prediction"].isin([0, 1, 2]).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
