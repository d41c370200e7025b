"""Queries that have SQL equal what DuckDB makes of it, on the smallest tables and on odd rows."""

from pathlib import Path

import duckdb
import pytest

from pairlocus.llm import queries

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def compared(spark, folder, name):
    got = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.skipif(not DATA.is_dir(), reason="the tables aren't here")
def test_query_equals_sql(spark, name):
    compared(spark, DATA, name)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql_on_odd_rows(spark, make_docs, odd_rows, tmp_path, name):
    more = [(100 + n, "word " * (n % 70), "abc"[n % 3]) for n in range(300)]
    make_docs(odd_rows * 2 + more).write.parquet(f"{tmp_path}/tables/documents.parquet")
    compared(spark, tmp_path / "tables", name)
