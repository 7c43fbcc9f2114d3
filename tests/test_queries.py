"""Every query with SQL gives the rows that DuckDB gives, at the smallest size."""

import glob
import os

import duckdb
import pytest

from cloakframe.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    assert columns == sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "masked_text"]
