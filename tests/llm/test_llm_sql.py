"""Queries of operators that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from tidemark.llm import queries


def shown(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    for path in ("/root/testdata/sf0.001", tables):
        con = duckdb.connect()
        for table in ("documents", "conversations", "pages"):
            suffix = "/*.parquet" if path == tables else ""
            con.execute(f"create view {table} as select * from read_parquet('{path}/{table}.parquet{suffix}')")
        df = queries.QUERIES[name](spark, path)
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert shown(map(tuple, df.select(columns).collect())) == shown(want.fetchall())
