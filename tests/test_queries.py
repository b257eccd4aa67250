"""Every named query of the catalog against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_gives_ranked_rows(spark):
    import __spark_entry__

    ranks = [r["rank"] for r in __spark_entry__.entry(spark).collect()]
    assert ranks and min(ranks) == 1 and max(ranks) <= 8


def test_walks_do_not_revisit(spark):
    for r in catalog.QUERIES["q_random_walks"](spark, SF).collect():
        assert len(set(r["path"])) == len(r["path"]) <= 6
