"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from tidelog import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
