"""Every query with oracle SQL against DuckDB, on the smallest given tables."""

from pathlib import Path

import pytest

from strandlake.plans import oracle, queries

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "conversations")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = queries.queries()[name](spark, str(DATA))
    result = duck.sql(oracle.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in result.fetchall())


def test_samples_assemble(spark):
    rows = queries.assemble(spark, str(DATA)).collect()
    assert rows and all(r.reads_used <= r.reads for r in rows)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
