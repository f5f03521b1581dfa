"""Landing logs once, reading partitions, and sessions whose number does not change the jobs."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from tests.market import ns, write_log
from tickweave.plans.sessions import Asset, Window, extract_sessions, save_sessions
from tickweave.sources import lake as lakes
from tickweave.sources import messages as src


def adds(date, n, extra=()):
    t0 = ns(date, "09:30")
    return [{"receipttimestamp": t0 + k * 10**9, "f": "x", "side": "Bid", "price": 10 + k, "quantity": 5, "orderreferencenumber": f"r{k}", **dict(extra)} for k in range(n)]


def test_files_are_landed_once(spark, tmp_path):
    root, lake, state = str(tmp_path / "log"), str(tmp_path / "lake"), str(tmp_path / "state")
    write_log(root, "20240103", "SPY", {"mt_add_order": adds("20240103", 5), "mt_unknown": adds("20240103", 1)})
    write_log(root, "20240104", "SPY", {"mt_add_order": adds("20240104", 7, {"sequencenumber": 2**53 + 1, "odd": "x"}), "mt_trade": []})
    (tmp_path / "log/20240104/SPY/mt_trade/part.csv").write_text("")
    assert sum(p["numInputRows"] for p in lakes.land(spark, root, lake, state)) == 3  # files that are not empty
    assert lakes.land(spark, root, lake, state) == []
    got = lakes.read(spark, lake)
    counts = {tuple(r)[:3]: r["count"] for r in got.groupBy("session_date", "product", "message_type").count().collect()}
    assert counts == {("20240103", "SPY", "mt_add_order"): 5, ("20240104", "SPY", "mt_add_order"): 7}
    assert got.where("sequencenumber = 9007199254740993").count() == 7  # the header of each file decides
    with open(os.path.join(root, "20240104/SPY/mt_add_order/qart.csv"), "w", newline="") as f:  # later, with its columns in another order
        w = csv.DictWriter(f, ["quantity", "f", "receipttimestamp"])
        w.writeheader()
        w.writerows({"quantity": 9, "f": "late", "receipttimestamp": 1} for _ in range(2))
    assert [p["numInputRows"] for p in lakes.land(spark, root, lake, state)] == [1]
    later = lakes.read(spark, lake, ["20240104"], ["SPY"], ["mt_add_order"])
    assert later.count() == 9 and {r["quantity"] for r in later.where("f = 'late'").collect()} == {9.0}
    direct = src.messages(spark, root, "20240103", "SPY", ["mt_add_order"])[0]
    same = lakes.read(spark, lake, ["20240103"]).select(direct.columns)
    assert sorted(same.collect(), key=repr) == sorted(direct.collect(), key=repr)
    assert [r["orderreferencenumber"] for r in later.orderBy("arrival").take(7)] == [f"r{k}" for k in range(7)]


def test_partitions_are_pruned(spark, tmp_path):
    root, lake = str(tmp_path / "log"), str(tmp_path / "lake")
    for date in ("20240103", "20240104", "20240105"):
        write_log(root, date, "SPY", {"mt_add_order": adds(date, 3)})
    lakes.land(spark, root, lake, str(tmp_path / "state"), ["20240103/SPY", "20240105/SPY"])
    df = lakes.pruned(spark, lake, ["20240105"], ["SPY"], ["mt_add_order"]).select("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "session_date" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<price:double>" in plan
    assert df.count() == 3 and lakes.pruned(spark, lake).select("session_date").distinct().count() == 2
    missing = lakes.failures(spark, lake, [("20240103", "SPY", "mt_add_order"), ("20240104", "SPY", "mt_add_order")]).collect()
    assert [tuple(r) for r in missing] == [("20240104", "SPY", "mt_add_order", "no rows")]


def test_text_is_scanned_once(spark, tmp_path):
    root = write_log(tmp_path, "20240103", "SPY", {"mt_add_order": adds("20240103", 4)})
    msgs, _ = src.messages(spark, root, "20240103", "SPY", ["mt_add_order"])
    plan = msgs._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower().replace(str(tmp_path).lower(), "") and msgs.count() == 4


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    for date in ("20250423", "20250424", "20250425", "20250428"):
        rows = adds(date, 6) + [r | {"side": "Ask", "price": r["price"] + 20, "orderreferencenumber": r["orderreferencenumber"] + "a"} for r in adds(date, 3)]
        write_log(root, date, "SPY", {"mt_add_order": rows, "mt_trade": [r | {"aggressorside": "Buy"} for r in adds(date, 4)]})
    return str(root)


def jobs(spark, run):
    spark.sparkContext.setJobGroup(name := f"counted-{os.urandom(4).hex()}", "")
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_sessions(spark, logs, tmp_path):
    dates = ["20250423", "20250424", "20250425", "20250428"]
    asset, minute = Asset("SPY", types=["mt_add_order"]), Window("09:30", "09:31", 10)

    def run(some, out):
        frame, stats = extract_sessions(spark, logs, [(d, "r") for d in some], [asset], 2, minute)
        save_sessions(frame, str(tmp_path / out))
        assert stats.count() == len(some)

    run(dates[:1], "warm")
    assert jobs(spark, lambda: run(dates, "four")) <= jobs(spark, lambda: run(dates[:1], "one")) + 3
    back = spark.read.parquet(str(tmp_path / "four"))
    assert back.count() == 7 * 4
    assert back.groupBy("session_date").agg(F.sum("SPY_trade_buy").alias("n")).where("n = 4").count() == 4
    run(dates[:2], "four")  # replaced, the other two stay
    assert spark.read.parquet(str(tmp_path / "four")).count() == 7 * 4


def test_what_is_absent_is_named(spark, logs):
    asset, minute = Asset("SPY", types=["mt_add_order", "mt_cancel_order"]), Window("09:30", "09:31", 10)
    with pytest.raises(FileNotFoundError, match="mt_cancel_order"):
        extract_sessions(spark, logs, [("20250423", "r")], [asset], 2, minute)
    _, stats = extract_sessions(spark, logs, [("20250423", "r"), ("20250101", "r")], [asset], 2, minute, on_missing="empty")
    got = {r["session_date"]: (r["absent"], r["events"]) for r in stats.collect()}
    assert got == {"20250423": (["mt_cancel_order"], 9), "20250101": (["mt_add_order", "mt_cancel_order", "mt_trade"], 0)}
