"""As-of joins, bitmaps, sketches, counters, the cube and the price model against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave import market_queries, queries
from tickweave.operators import asof, book, checks, coverage, price_discovery, sketches

DIR = "/root/testdata/sf0.001"


def plain_asof(left, right, tolerance, exact, forward):
    out = []
    for n, k, t in left:
        best = None
        for k2, t2, tie, v in right:
            if t is None or t2 is None or k != k2 or (t2 == t and not exact) or (t2 < t if forward else t2 > t):
                continue
            if tolerance is not None and abs(t - t2) > tolerance:
                continue
            rank = (-t2, -tie) if forward else (t2, tie)
            best = max(best, (rank, t2, v)) if best else (rank, t2, v)
        out.append((n, best[1] if best else None, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tolerance", "exact", "forward", "block"), [(None, True, False, 7), (None, False, True, 1), (6, True, True, 1000), (6, False, False, 3)])
def test_asof_is_the_definition(spark, tolerance, exact, forward, block):
    rng = random.Random(block)
    key = lambda: rng.choice(["a", "b", None, "hot", "hot"])
    left = [(n, key(), rng.randint(-30, 90) if rng.random() > 0.05 else None) for n in range(80)] + [(5, "hot", 40)] * 2
    right = [(key(), rng.randint(-30, 60) if rng.random() > 0.05 else None, tie, rng.choice([None, float(tie)])) for tie in range(60)]
    a = spark.createDataFrame(left, "n int, k string, t long").repartition(3)
    b = spark.createDataFrame(right, "k string, t long, tie long, v double").repartition(3)
    got = asof.asof_join(a, b, ["k"], "t", ["v"], "tie", block, tolerance, exact, forward)
    assert got.columns == ["n", "k", "t", "at", "v"]
    assert sorted(((r["n"], r["at"], r["v"]) for r in got.collect()), key=repr) == plain_asof(left, right, tolerance, exact, forward)


def test_asof_of_empty_sides(spark):
    a = spark.createDataFrame([(1, "a", 5)], "n int, k string, t long")
    b = spark.createDataFrame([], "k string, t long, tie long, v double")
    assert [tuple(r) for r in asof.asof_join(a, b, ["k"], "t", ["v"], "tie", 10).collect()] == [(1, "a", 5, None, None)]
    assert asof.asof_join(a.where("n > 1"), b, ["k"], "t", ["v"], "tie", 10).count() == 0


@pytest.mark.parametrize("block", [1, 10, 32_768])
def test_gaps_and_bitmaps(spark, block):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, rng.randint(1, 70_000), rng.randint(1, 60)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "f string, seq long").repartition(3)
    want, shares = [], {}
    for f in "ab":
        have = sorted({s for g, s in rows if g == f and s is not None})
        want += [(f, x + 1, y - 1, y - x - 1) for x, y in zip(have, have[1:], strict=False) if y - x > 1]
        shares[f] = (have[-1] - have[0] + 1, len(have))
    assert sorted(map(tuple, coverage.gaps(df, block).collect())) == sorted(want)
    parts = coverage.bitmaps(df.withColumn("part", F.col("seq") % 3), ["f", "part"])
    assert {r["f"]: (r["span"], r["present"]) for r in coverage.continuity(coverage.merged(parts)).collect()} == shares


def test_merged_sketches_keep_their_error(spark):
    rng = np.random.default_rng(2)
    values = [(f"F{k % 3}", int(k % 24), float(v)) for k, v in enumerate(rng.lognormal(size=60_000))] + [("F0", 0, None), ("F0", 0, float("nan")), ("G", 0, None)]
    df = spark.createDataFrame(values, "f string, hour int, price double").repartition(4).cache()
    by_feed = sketches.merged(sketches.sketched(df, ["f", "hour"]), ["f"])
    whole = sketches.merged(by_feed, [])
    for q in (0.01, 0.5, 0.99):
        errors = sketches.rank_errors(df, by_feed.withColumn("answer", sketches.quantile(q)), ["f"], q).collect()
        assert len(errors) == 3 and all(r["error"] <= sketches.RANK_ERROR and r["n"] == 20_000 for r in errors)
        one = sketches.rank_errors(df, whole.withColumn("answer", sketches.quantile(q)), [], q).first()
        assert one["n"] == 60_000 and one["error"] <= sketches.RANK_ERROR


def test_sketched_medians_find_what_exact_ones_find(spark):
    m = queries.msgs(spark, DIR).withColumn("price", F.when(F.col("f") == "F2", F.col("price") * 100).otherwise(F.col("price")))
    exact, near = (checks.check_fields(m, e).where("subject = 'all'").collect() for e in (True, False))
    assert len(exact) == len(near) == 1 and exact[0]["message"] == near[0]["message"] and abs(exact[0]["value"] / near[0]["value"] - 1) < 0.2
    health = {r["f"]: r for r in checks.field_health(m, False).collect()}
    assert all(abs(r["median_price"] / health[r["f"]]["median_price"] - 1) < 0.1 and r["n"] == health[r["f"]]["n"] for r in checks.field_health(m).collect())


def test_the_cube_rolls_up(spark):
    m = queries.msgs(spark, DIR)
    cube = market_queries.message_cube(spark, DIR).cache()
    pick = lambda level, *cols: sorted(tuple(r) for r in cube.where(F.col("level") == level).select(*cols, "n").collect())
    assert pick("type", "message_type") == sorted(tuple(r) for r in checks.inventory(m).collect())
    matrix = {r["f"]: r.asDict() for r in checks.feed_matrix(m).collect()}
    assert all(matrix[f][t] == n for f, t, n in pick("feed,type", "f", "message_type"))
    assert sum(r["n"] for r in cube.where("level = 'feed,type,hour'").collect()) == cube.where("level = 'all'").first()["n"] == m.count()


def test_counters_are_counted_in_passing(spark):
    rows = [("A", "ADD", "Bid", 1.0, 0.0, "a"), ("A", "ADD", None, 1.0, 2.0, "b"), ("A", "ADD", "Ask", 1.0, 2.0, None), (None, "CANCEL", None, None, None, "a"), ("L", "LEVEL_SET", "Bid", 1.0, 5.0, None)]
    df = spark.createDataFrame(rows, "f string, code string, side string, price double, qty double, ref string").withColumns({"ts_ns": F.when(F.col("ref") == "a", F.lit(5).cast("long")), "seq": F.lit(None).cast("long")})
    seen, counters = book.counted(df)
    assert seen.count() == 5
    assert counters.get == {"rows": 5, "no_clock": 3, "no_feed": 1, "no_seq": 5, "no_ref": 1, "rejected_adds": 2}


def simulated(n=4000, seed=3):
    """Two prices of one good: y follows x."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros(n), np.zeros(n)
    for t in range(1, n):
        x[t] = x[t - 1] + rng.normal()
        y[t] = y[t - 1] + 0.4 * (x[t - 1] - y[t - 1]) + 0.2 * rng.normal()
    return np.round(x * 100), np.round(y * 100)


def test_information_shares_are_numpys(spark):
    lags, (x, y) = 2, simulated()
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "n long, x double, y double").repartition(3)
    names = price_discovery.columns(lags)
    got = price_discovery.shares(price_discovery.gram(price_discovery.lagged(df, lags), names), lags)
    dx, dy, rows = np.diff(x), np.diff(y), range(lags, len(x) - 1)
    design = np.array([[1, x[t] - y[t], *[d[t - k] for k in range(1, lags + 1) for d in (dx, dy)]] for t in rows])
    target = np.array([[dx[t], dy[t]] for t in rows])
    beta = np.linalg.lstsq(design, target, rcond=None)[0]
    rest = target - design @ beta
    omega = rest.T @ rest / len(rest)
    assert np.allclose(got.adjustment, beta[1], rtol=1e-6, atol=1e-9) and np.allclose(got.covariance, omega, rtol=1e-6)
    assert abs(got.component.sum() - 1) < 1e-12 and (got.least <= got.greatest).all() and (got.least >= 0).all() and (got.greatest <= 1).all()
    assert got.least[0] > 0.9 and got.component[0] > 0.9  # x leads
    flipped = price_discovery.shares(price_discovery.gram(price_discovery.lagged(df.select("n", F.col("y").alias("x"), F.col("x").alias("y")), lags), names), lags)
    assert np.allclose(flipped.least[::-1], got.least, rtol=1e-6) and np.allclose(flipped.greatest[::-1], got.greatest, rtol=1e-6)
    with pytest.raises(ValueError):
        price_discovery.shares(price_discovery.gram(price_discovery.lagged(df.where("n < 5"), lags), names), lags)


def test_asof_query_against_asof_join(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    got = market_queries.asof_quotes(spark, DIR)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({market_queries.ORACLES['asof_quotes']})").fetchall(), key=repr)
