"""Every query with SQL gives what DuckDB makes of that SQL; every other query gives rows of a stable schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if QUERIES[n] in entry.registry.QUERIES.values()]


@pytest.fixture(scope="module")
def duck(data):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    mine = df.collect()
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(mine, df.columns) == canonical(cursor.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
