"""Every query of the engine against its SQL, on tables large enough for every query to have rows."""

import duckdb
import pandas as pd
import pytest

from ledgermark import tables
from ledgermark.plans import registry, registry_stored  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "customer orders lineitem events documents benchmark labels pages".split()
FIRST = {}
for _n, _f in registry.QUERIES.items():
    FIRST.setdefault(_f, _n)  # names that share a plan are run once


def cells(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v or str(v) == "NaT":
            return "-"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in FIRST.values() if n in registry.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    tables.clear(spark)
    assert len(got)
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
