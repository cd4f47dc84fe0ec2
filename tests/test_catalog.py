"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from spindrift.catalog import ORACLE_SQL, QUERIES


def cells(row):
    return tuple("~" if x is None else repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(cells(r) for r in df.select(*columns).collect())
    assert rows
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(cells(r) for r in duck.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall())
