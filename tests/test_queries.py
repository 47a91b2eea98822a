"""Every query of the engine's own operators against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from quaystone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return None if pd.isna(x) else x if isinstance(x, str | bool) else round(float(x), 6) if hasattr(x, "__float__") else x


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(str(tuple(map(value, r))) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/*.parquet'" if os.path.isdir(at) else f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
