"""Each fleet query against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from axleyard.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, round(v, 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0, str(v) if not isinstance(v, (int, float)) or isinstance(v, bool) else "") for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert len(got) == len(want)
    for g, w in zip(got, ordered(want)):
        assert all(same(x, y) for x, y in zip(g, w)), (g, w)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["emissions_daily"](spark, SF).count() > 0
