"""Every query of the subpackage with SQL gives what DuckDB makes of that SQL."""

import glob
import os

import duckdb
import pytest

from quartzbar.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), names)
