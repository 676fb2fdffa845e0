"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import kv

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(repr([None if v is None else int(v) if isinstance(v, bool) else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(kv.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = kv.QUERIES[name](spark, DATA)
    want = sql.execute(kv.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(map(tuple, df.select(columns).collect())) == plain(want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
