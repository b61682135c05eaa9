import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pluvia.plans.queries import SQL, Q
from pluvia.sources.scratch import cleared

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = [tuple(None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in pdf.itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    with cleared(spark):
        got = Q[name](spark, D).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
