"""Every registered query beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()



@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLES[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ServiceName", "total"]
    assert not df.isEmpty()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
