"""Every query with SQL gives what DuckDB gives on the same tables; every other one runs and has a stable shape."""

import duckdb
import pytest

from tracklens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    clean = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return names, sorted((repr(tuple(clean(r[i]) for i in at)) for r in rows))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.limit(5).collect()
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
