"""Every query with SQL against DuckDB, every other one for rows, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{root}/{f}')")
    return con


def _rows(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, root, duck, name):
    got = [r.asDict(recursive=True) for r in QUERIES[name](spark, root).collect()]
    want = duck.sql(ORACLE[name])
    cols = want.columns
    assert _rows(got) == _rows(dict(zip(cols, r, strict=True)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, root, name):
    df = QUERIES[name](spark, root)
    assert df.columns
    if name != "p7_found":
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_llm_is_optional():
    assert all(m.__name__.split(".")[1] != "llm" for m in (__import__("importlib").import_module(x) for x in entry._MODULES))
