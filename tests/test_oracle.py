"""Every registered query against its SQL on DuckDB, on the smallest test tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, rows_of
from wayframe.catalog import load

SF = "/root/testdata/sf0.001"
#: The queries of this catalogue; the optional corpus operators have tests of their own.
SQL = {name: text for name, text in oracle_sql().items() if name in load()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(load()) == set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want)


def test_flagship_counts(spark):
    """The known counts of this input, before stationary thinning."""
    got = {r["reason"]: r["frames"] for r in queries()["rejection_reason"](spark, SF).collect()}
    assert got == {"behind": 46, "future_missing": 59, "jump": 45, "stationary": 24, "written": 169}
    assert entry(spark).count() == 15
