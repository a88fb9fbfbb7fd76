"""Every query with an oracle, at the smallest scale, against DuckDB."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from fieldrecon.sources.bindings import TABLES

sys.path.insert(0, "tools")
from tools.check_oracle import rows  # noqa: E402


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_tree_sink_skips_and_replaces(spark, tmp_path):
    from fieldrecon.sources import sinks

    path = str(tmp_path / "tree")
    make = lambda rows: spark.createDataFrame(rows, "team int, region string, category string, identifier string, v int")
    keys = ["team", "region", "category", "identifier"]
    sinks.write_tree(make([(1, "A", "X", "a", 1), (2, "A", "X", "b", 1)]), path, keys)
    sinks.write_tree(make([(1, "A", "X", "a", 2), (1, "A", "X", "c", 2)]), path, keys, overwrite=False)
    got = {(r["identifier"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 2)}
    sinks.write_tree(make([(1, "A", "X", "a", 3)]), path, keys)
    got = {(r["identifier"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 3), ("b", 1)}
