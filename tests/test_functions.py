import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickweave.functions import calendar, features
from tickweave.plans.sessions import contract_of


def test_contract_calendar(spark):
    days = spark.createDataFrame([(dt.date(2020, 3, 11),), (dt.date(2020, 3, 16),)], "d date")
    assert [r[0] for r in days.select(calendar.front_month(F.lit("ES"), F.col("d"))).collect()] == ["ESH0", "ESM0"]
    assert [contract_of("ES", dt.date(2020, 3, 11)), contract_of("ES", dt.date(2020, 3, 16))] == ["ESH0", "ESM0"]
    one = spark.range(1).select(calendar.contract_expiry(F.lit("ESH0"), F.lit(2020)).alias("e"), calendar.futures_root(F.lit("esm0")).alias("r"), calendar.canonical_root(F.lit("spy"), "direct").alias("c")).first()
    assert (one["e"], one["r"], one["c"]) == (dt.date(2020, 3, 20), "ES", "SPY")
    with pytest.raises(Exception):
        spark.range(1).select(calendar.contract_expiry(F.lit("ESA0"), F.lit(2020))).collect()
    with pytest.raises(ValueError):
        calendar.canonical_root(F.lit("spy"), "future")


def walk(levels, lot):
    need, cost, used = lot, 0.0, 0
    for p, q in levels:
        q = q if p is not None and q is not None else 0.0
        take = min(need, q)
        if take > 0:
            cost, used, need = cost + p * take, used + 1, need - take
    return (cost / lot if need <= 1e-12 else None), lot - need, used


def test_vwap_equals_the_row_walk(spark):
    rng = random.Random(3)
    books = {k: [(round(100 + 0.01 * i, 2) if rng.random() > 0.1 else None, float(rng.randint(1, 80)) if rng.random() > 0.1 else None) for i in range(6)] for k in range(80)}
    rows = [(k, i + 1, p, q) for k, b in books.items() for i, (p, q) in enumerate(b)]
    df = spark.createDataFrame(rows, "k long, level int, price double, qty double")
    for r in features.vwap_to_lot(df, ["k"], 120.0).collect():
        v, filled, used = walk(books[r["k"]], 120.0)
        assert (r["vwap"] is None) == (v is None) and r["levels_used"] == used and r["filled"] == pytest.approx(filled)
        assert v is None or r["vwap"] == pytest.approx(v)


def test_a_heavy_bid_pulls_the_microprice_up(spark):
    df = spark.createDataFrame([(10.0, 500.0, 10.1, 100.0), (10.0, 100.0, 10.1, 100.0)], "X_bidprice_1 double, X_bidquantity_1 double, X_askprice_1 double, X_askquantity_1 double")
    a, b = features.with_features(df, "X").collect()
    assert a["X_wmid"] > a["X_mid"] and b["X_wmid"] == pytest.approx(b["X_mid"]) and b["X_spread_bps"] == pytest.approx(0.1 / 10.05 * 1e4)


def test_shape_of_a_side(spark):
    rows = [("a", k, 100 + 0.01 * k, 10.0) for k in range(1, 6)] + [("b", 1, 100.0, 1.0), ("b", 2, 100.01, 1.0), ("b", 3, 109.0, 50.0), ("c", 1, 5.0, 5.0), ("c", 2, None, 5.0)]
    got = {r["k"]: r for r in features.side_costs(spark.createDataFrame(rows, "k string, level int, price double, qty double"), ["k"]).collect()}
    assert got["a"]["impact_length"] == pytest.approx(2**0.5) and 2**0.5 <= got["b"]["impact_length"] <= 2 and got["c"]["impact_length"] is None
    assert got["c"]["decay_cost_bps"] == 0 and got["b"]["decay_cost_bps"] > got["a"]["decay_cost_bps"] > 0
    mid = spark.range(1).select(features.depth_weighted_mid([(F.lit(10.0), F.lit(1.0), F.lit(11.0), F.lit(2.0)), (F.lit(9.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0))])).first()[0]
    assert mid == pytest.approx((9.5 + 11.0) / 2)
