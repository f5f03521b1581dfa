"""Every query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from tickweave import log_queries, market_queries
from tickweave import queries as base
from tickweave.operators.checks import verdict

QUERIES = base.QUERIES | log_queries.QUERIES | market_queries.QUERIES
ORACLES = base.ORACLES | log_queries.ORACLES | market_queries.ORACLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
        assert got == want


def test_minor_does_not_outvote(spark):
    found = spark.createDataFrame([("CODE", "FATAL"), ("DATA", "MINOR"), ("DATA", "MINOR")], "kind string, severity string")
    assert tuple(verdict(found).first()) == ("CODE", 3, 0, 1)
    assert tuple(verdict(found.where("kind = 'X'")).first())[:2] == ("NONE", 0)


def test_entry_points_work_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
