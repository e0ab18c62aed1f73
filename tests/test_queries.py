"""Every registered raster query equals its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from rasterloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(row):
    out = []
    for v in row:
        if v is None or isinstance(v, float) and math.isnan(v):
            out.append((1, ""))
        elif isinstance(v, float):
            out.append((0, repr(round(v, 8) + 0.0)))
        else:
            out.append((0, str(v.date() if isinstance(v, datetime.datetime) else v)))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(plain(r) for r in df.select(*columns).collect()) == sorted(plain(r) for r in want)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_the_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns[:2] == ["number", "color"]
