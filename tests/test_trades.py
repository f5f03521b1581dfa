import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.market import ns, tape, write_log
from tickweave.operators import trades
from tickweave.operators.blocks import carried, running_max, ticks
from tickweave.sources import messages as src


def test_breaks_and_corrections(spark, tmp_path):
    date = "20250403"
    t = ns(date, "10:00")
    prints = [(540.00, 101), (540.10, 102), (553.45, 103), (540.20, 104)]
    log = {
        "mt_trade": [{"receipttimestamp": t + k * 10**9, "price": p, "quantity": 100, "aggressorside": "", "side": "", "printable": "Printable", "matchid": m} for k, (p, m) in enumerate(prints)] + [{"receipttimestamp": t + 2 * 10**9, "price": 1.0, "quantity": 9, "matchid": 105}],
        "mt_trade_break": [{"receipttimestamp": t, "matchid": 102, "price": 540.1, "quantity": 100}],
        "mt_trade_correction": [{"receipttimestamp": t, "matchid": 103, "oldprice": 553.45, "newprice": 9.0, "newquantity": 7}, {"receipttimestamp": t, "matchid": 103, "oldprice": 553.45, "newprice": 543.45, "newquantity": 100}],
    }
    root = write_log(tmp_path, date, "SPY", log)
    read = lambda k: src.messages(spark, root, date, "SPY", [k])[0]
    raw = read("mt_trade")
    clean = trades.scrub(raw, read("mt_trade_break"), read("mt_trade_correction"))
    got = {r["matchid"]: (r["price"], r["quantity"]) for r in clean.collect()}
    assert got == {101: (540.0, 100.0), 103: (543.45, 100.0), 104: (540.2, 100.0), 105: (1.0, 9.0)}  # a print of the same time is untouched
    assert tuple(trades.scrub_stats(raw, clean).first()) == (5, 1, 1)


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_running_functions_do_not_depend_on_blocks(spark, blocks):
    rows = [(k, None if k % 4 == 0 else float(k * 7 % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5).withColumn("b", F.floor(F.col("k") * blocks / 60))
    out = running_max(ticks(carried(df, ["v"], ["k"], "b"), "v", ["k"], "b", "t"), "v", ["k"], "b", "m").orderBy("k").toPandas()
    v = pd.Series([x for _, x in rows], dtype=float)
    tick = np.sign(v.diff()).replace(0, np.nan).ffill()
    for name, want in (("v_was", v.ffill().shift()), ("v_filled", v.ffill()), ("m", v.cummax().ffill()), ("t", tick)):
        assert out[name].astype(float).fillna(-9).tolist() == want.fillna(-9).tolist(), name


def signs(spark, tmp_path, futures, how):
    date = "20200312"
    root = write_log(tmp_path, date, "X", tape(date, n=90, futures=futures))
    t = trades.printable_only(src.messages(spark, root, date, "X", ["mt_trade"])[0])
    return trades.signed(t, ["ts_ns", "arrival"], F.expr("ts_ns div 7000000000"), how).withColumn("ts_us", F.expr("ts_ns div 1000")), root


def test_futures_tape_by_aggressor(spark, tmp_path):
    t, _ = signs(spark, tmp_path, True, "aggressor")
    assert t.where("sign > 0").count() == t.where("trim(aggressorside) = 'Buy'").count() and t.where("sign = 0").isEmpty()


def test_equity_tape_by_ticks(spark, tmp_path):
    t, _ = signs(spark, tmp_path, False, "aggressor")
    rows = t.orderBy("ts_ns").collect()
    last, want = None, []
    sign = 0
    for r in rows:
        if last is not None and r["price"] != last:
            sign = 1 if r["price"] > last else -1
        last = r["price"]
        want.append(sign)
    assert [r["sign"] for r in rows] == want and len(rows) == 90 - 13


def test_buckets_are_dense_and_flow_joins_the_grid(spark, tmp_path):
    t, _ = signs(spark, tmp_path, True, "side")
    holes = t.where("ts_us % 20000000 < 10000000")
    b = trades.trade_buckets(holes, 5_000_000, ["ts_ns", "arrival"], tz="America/New_York").orderBy("bucket_us").toPandas()
    assert (b["bucket_us"].diff().dropna() == 5_000_000).all() and (b["trade_count"] == 0).any()
    assert b.loc[b["trade_count"] == 0, "trade_volume"].isna().all() and b["trade_count"].sum() == holes.count()
    flow = trades.flow(spark.createDataFrame(b), "ES", 0.01)
    grid = spark.createDataFrame([(int(b["bucket_us"].min()) - 5_000_000,), (int(b["bucket_us"].min()),)], "ts_us long")
    rows = trades.attach_flow(grid, [flow], 5_000_000).orderBy("ts_us").collect()
    assert rows[0]["ES_trade_buy"] == 0 and rows[0]["ES_trade_px"] is None and rows[1]["ES_trade_px"] < 10
    with pytest.raises(ValueError):
        trades.bucket_us(F.col("x"), 7_000_001)
    assert trades.flow_counts(grid, ["ES"], F.lit(0)) is None and not trades.has_trade_flow(grid.columns, ["ES"])
