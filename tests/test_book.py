import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.market import multi_venue, ns, out_of_order, write_log
from tickweave.operators import book, ladder, replay_checks
from tickweave.operators.fold import fold_book
from tickweave.operators.ordering import coverage, ordered_events
from tickweave.plans.diagnose import diagnose, replayed, report
from tickweave.plans.sessions import Asset, Window, extract_sessions, session_book
from tickweave.schemas import EVENTS, canonical_schema
from tickweave.sources import messages as src

MINUTE = Window("09:30", "09:31")


def test_consolidated_book_and_events(spark, tmp_path):
    root = write_log(tmp_path, "20250423", "SPY", multi_venue())
    wide, stats = session_book(spark, root, "20250423", Asset("SPY"), 10, MINUTE, on_missing="empty")
    rows = wide.orderBy("ts").collect()
    assert len(rows) == 61 and {f.name for f in canonical_schema("SPY", 10)} == set(wide.columns)
    side = lambda r, s, n: [(r[f"SPY_{s}price_{k}"], r[f"SPY_{s}quantity_{k}"]) for k in range(1, n + 1)]
    a, b = rows[0], rows[2]
    assert side(a, "bid", 4) == [(536.66, 500.0), (536.65, 300.0), (536.60, 200.0), (536.50, 40.0)]
    assert side(a, "ask", 3) == [(536.68, 300.0), (536.70, 200.0), (536.72, 100.0)]
    assert (a["SPY_nbbo_bid"], a["SPY_nbbo_ask"]) == (536.66, 536.68) and a["SPY_mid"] == pytest.approx(536.67)
    assert side(b, "bid", 1) == [(536.60, 200.0)] and side(b, "ask", 2) == [(536.69, 100.0), (536.70, 150.0)]
    assert b["SPY_bidprice_4"] is None and b["SPY_bidquantity_4"] == 0.0
    s = stats.first()
    assert s["crossed"] == 0 and s["n_add"] == 7 and s["cancel_no_order"] == 0 and s["modify_reprioritized"] == 1 and s["mbp_level_events"] == 2
    lots, _ = session_book(spark, root, "20250423", Asset("SPY"), 4, MINUTE, odd_lots=False, on_missing="empty")
    assert all(40.0 not in (r[f"SPY_bidquantity_{k}"] for k in range(1, 5)) for r in lots.collect())
    again = ladder.validate(wide, wide, "SPY", 10).collect()
    assert again and all(r["match_rate"] == 1.0 for r in again)


def test_price_levels_of_futures(spark, tmp_path):
    t0 = ns("20250423", "09:30")
    lv = lambda t, side, p, q: {"receipttimestamp": t, "f": "cme", "side": side, "price": p, "quantity": q}
    rows = [lv(t0, "Bid", 543750, 5), lv(t0, "Ask", 543775, 8), lv(t0, "Bid", 543725, 12), lv(t0, "Ask", 543800, 6), lv(t0 + 10**9, "Bid", 543750, 0)]
    root = write_log(tmp_path, "20250423", "ESM5", {"mt_price_level_update": rows})
    asset = Asset("ES", "futures", 0.01, ["mt_price_level_update"])
    wide, _ = session_book(spark, root, "20250423", asset, 3, MINUTE)
    a, b = wide.orderBy("ts").take(2)
    assert (a["ES_bidprice_1"], a["ES_bidquantity_1"], a["ES_askprice_1"]) == (5437.5, 5.0, 5437.75) and a["ES_bidprice_2"] == 5437.25 and b["ES_bidprice_1"] == 5437.25


def test_large_and_alphanumeric_references(spark, tmp_path):
    t0 = ns("20250423", "09:30")
    add = lambda side, p, q, r: {"receipttimestamp": t0, "f": "bats_edgx", "side": side, "price": p, "quantity": q, "orderreferencenumber": r}
    log = {"mt_add_order": [add("Bid", 100.0, 10, "9223372036854775815"), add("Bid", 100.0, 20, "9223372036854775816"), add("Ask", 100.05, 30, "ORD-A1B2")], "mt_cancel_order": [{"receipttimestamp": t0 + 10**9, "f": "bats_edgx", "side": "Bid", "price": 100.0, "previousquantity": 10, "orderreferencenumber": "9223372036854775815"}]}
    wide, _ = session_book(spark, write_log(tmp_path, "20250423", "X", log), "20250423", Asset("X", types=list(log)), 1, MINUTE)
    a, b = wide.orderBy("ts").take(2)
    assert (a["X_bidquantity_1"], b["X_bidquantity_1"], b["X_askquantity_1"]) == (30.0, 20.0, 30.0)


@pytest.fixture(scope="module")
def disorder(spark, tmp_path_factory):
    out = {}
    for name, seq in (("with", True), ("without", False)):
        root = write_log(tmp_path_factory.mktemp(name), "20240103", "SPY", out_of_order(sequence=seq))
        out[name] = src.messages(spark, root, "20240103", "SPY", ["mt_add_order", "mt_modify_order", "mt_cancel_order", "mt_trade"])[0].where("f <> 'none'").cache()
    return out


DAY = Window("09:30", "16:00", 10)


def rate(msgs, order_by="sequence"):
    g0, step, points = DAY.of("20240103")
    return ladder.crossed_rate(replay_checks.spans_of(src.replay_events(msgs), g0 * 1000, step * 1000, points, order_by), points).first()["rate"]


def test_own_sequence_heals_the_book(spark, disorder):
    assert rate(disorder["with"]) < 0.01 and rate(disorder["without"]) > 0.5 and rate(disorder["with"], "clock") > 0.5
    assert coverage(src.replay_events(disorder["without"])).first()["warning"] == "ORDERING DEGRADED"


def test_diagnosis_names_the_cause(spark, disorder):
    replay = replayed(disorder["without"], "20240103", DAY)
    text, rc = report(diagnose(disorder["without"], "20240103", DAY, replay=replay), replay)
    assert "revived orders by feed: f=bats_edgx, n=800" in text and "wrong side, oldest: f=" in text and "born=09:30:" in text and "pinned prices: f=" in text and "sextile=5" in text
    assert rc == 3 and "sequencenumber" in text and "verdict: CODE" in text and "resurrections" in text
    healthy = diagnose(disorder["with"], "20240103", DAY)
    assert healthy.where("severity <> 'MINOR'").isEmpty(), healthy.collect()
    assert replay.resurrections().count() == 1600 and replay.wrong_side().count() == 1562


def stream(rng, n=150):
    rows = []
    for k in range(n):
        f = rng.choice(["A", "B", "L"])
        code = rng.choice(["ADD", "ADD", "CANCEL", "MODIFY", "TRADE", "TRADE"]) if f != "L" else rng.choice(["LEVEL_SET", "LEVEL_SET", "LEVEL_DEL", "TRADE", "ADD"])
        bad = rng.random() < 0.06
        ref, prev = rng.choice("abcdefgh"), rng.choice("abcdefgh")
        rows.append((f, code, rng.choice(["Bid", "Ask"]) if rng.random() > 0.03 else "?", float(rng.randint(1, 5)) if rng.random() > 0.05 else None, -1.0 if bad and code == "ADD" else float(rng.randint(1, 9)), ref, prev if code == "MODIFY" and rng.random() < 0.6 else ref, rng.random() < 0.5, k if rng.random() > 0.05 else None, 1000 * k + rng.randint(-3000, 3000), k))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = stream(rng)
    if seed == 5:  # a modify to an invalid size under another reference: its feed is folded
        rows.append(("A", "MODIFY", "Bid", 2.0, 0.0, "a", "b", True, 1000, 10**6, 1000))
    ordered = ordered_events(spark.createDataFrame(rows, EVENTS).repartition(3), "sequence").cache()

    def last(df):
        pdf = df.toPandas().sort_values(["f", "k1", "k2", "arrival", "sub"], kind="stable")
        pdf["level"] = pdf["level"].where(pdf["level"] > 1e-9, 0.0)
        return pdf.groupby(["f", "k1", "k2", "arrival", "side", "price"])["level"].last()

    a, b = last(book.levels(ordered)), last(fold_book(ordered))
    both = pd.concat([a, b], axis=1, keys=["windows", "fold"])
    assert len(a) and ((both["windows"] - both["fold"]).abs() < 1e-9).all(), both[(both["windows"] - both["fold"]).abs() > 1e-9]


def test_order_is_independent_of_partitions(spark):
    rows = stream(random.Random(9), 300)
    one = spark.createDataFrame(rows, EVENTS)
    runs = [ordered_events(one.repartition(n), block=b).select("arrival", "eff_ts").orderBy("arrival").collect() for n, b in ((1, 10**6), (7, 10))]
    assert runs[0] == runs[1]


def test_pruned_ladder_equals_the_plain_one(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.choice(["Bid", "Ask"]), float(rng.randint(1, 12)), float(rng.randint(1, 300)), lo, lo + rng.randint(1, 150)) for lo in range(0, 200, 2)]
    spans = spark.createDataFrame(rows, "f string, side string, price double, qty double, lo long, hi long").dropDuplicates(["f", "side", "price"])
    held = spans.collect()
    for n in (1, 3):
        got = {}
        for r in ladder.standing(spans, n, ["f"]).collect():
            got.setdefault((r["gi"], r["f"], r["side"]), set()).add(r["price"])
        for gi in range(0, 350, 7):
            for f in "AB":
                for side in ("Bid", "Ask"):
                    prices = sorted({r["price"] for r in held if r["f"] == f and r["side"] == side and r["lo"] <= gi < r["hi"]}, reverse=side == "Bid")[:n]
                    assert got.get((gi, f, side), set()) == set(prices)


def test_sessions_with_flow(spark, tmp_path):
    for date in ("20250423", "20250424"):
        t0 = ns(date, "09:30")
        spy = [{"receipttimestamp": t0 + k * 10**9, "f": "bats_edgx", "side": s, "price": round(550 + (0.05 if s == "Ask" else 0) + (0.01 if s == "Ask" else -0.01) * (k % 3), 2), "quantity": 100, "orderreferencenumber": f"s{s}{k}"} for k in range(20) for s in ("Bid", "Ask")]
        es = [{"receipttimestamp": t0 + k * 10**9, "f": "cme", "side": s, "price": 550000 + (50 if s == "Ask" else 0) + (100 if s == "Ask" else -100) * (k % 3), "quantity": 5, "orderreferencenumber": f"e{s}{k}"} for k in range(20) for s in ("Bid", "Ask")]
        trades_ = [{"receipttimestamp": t0 + k * 10**9, "price": 550.0, "quantity": 1, "aggressorside": "Buy", "side": "Bid", "printable": "Printable", "matchid": k} for k in range(10)]
        write_log(tmp_path, date, "SPY", {"mt_add_order": spy, "mt_trade": trades_})
        write_log(tmp_path, date, "ESM5", {"mt_add_order": es, "mt_trade": trades_})
    assets = [Asset("SPY", types=["mt_add_order"]), Asset("ES", "futures", 0.01, ["mt_add_order"])]
    both, stats = extract_sessions(spark, str(tmp_path), [("20250424", "calm"), ("20250423", "crash")], assets, 2, Window("09:30", "09:31", 1))
    pdf = both.toPandas()
    assert pdf["session_date"].drop_duplicates().tolist() == ["20250424", "20250423"] and len(pdf) == 122 and stats.count() == 4
    assert abs(pdf["ES_bidprice_1"].median() - 5500) < 5 and pdf["SPY_trade_buy"].sum() == 20
    alone, _ = extract_sessions(spark, str(tmp_path), [("20250423", "crash")], assets, 2, Window("09:30", "09:31", 1))
    pd.testing.assert_frame_equal(alone.toPandas(), pdf[pdf["session_date"] == "20250423"].reset_index(drop=True))


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for r in stream(random.Random(2), 120) if r[8] is not None and r[0] != "L"]
    df = spark.createDataFrame(rows, EVENTS)
    for k in range(2):  # two triggers, in sequence
        df.where((F.col("arrival") >= 60 * k) & (F.col("arrival") < 60 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from tickweave.streaming.replay import level_changes

    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = level_changes(source).writeStream.format("memory").queryName("levels").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("levels").toPandas().sort_values(["f", "arrival"], kind="stable").groupby(["f", "side", "price"])["level"].last()
    ordered = ordered_events(df)
    want = fold_book(ordered).toPandas().sort_values(["f", "k1", "k2", "arrival", "sub"], kind="stable").groupby(["f", "side", "price"])["level"].last()
    assert got.to_dict() == pytest.approx(want.to_dict())


def test_stream_waits_for_late_sequences(spark, tmp_path):
    rows = [r for r in stream(random.Random(3), 120) if r[8] is not None and r[0] != "L"]
    df = spark.createDataFrame(rows, EVENTS)
    for k in (0, 1):  # odd sequences come a trigger later; then one far ahead of each feed
        df.where((F.col("arrival") % 2 == k) & (F.col("arrival") < 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = [(f, "CANCEL", "Bid", None, 1.0, "none", "none", True, 10_000, 10**9, 10_000) for f in "AB"]
    spark.createDataFrame(last, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from tickweave.streaming.replay import level_changes

    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = level_changes(source, hold=1000).writeStream.format("memory").queryName("late").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    pdf = spark.table("late").toPandas()
    got = pdf.groupby(["f", "side", "price"])["level"].last()
    want = fold_book(ordered_events(df.where("arrival < 100"))).toPandas().sort_values(["f", "k1", "k2", "arrival", "sub"], kind="stable").groupby(["f", "side", "price"])["level"].last()
    assert got.to_dict() == pytest.approx(want.to_dict())


def test_stream_of_trades(spark, tmp_path):
    rows = [(f"2024-01-03 10:00:{s:02d}", 100.0 + s, 2.0, "Buy" if s % 2 else "sell ") for s in range(0, 40)]
    spark.createDataFrame(rows, "t string, price double, quantity double, aggressorside string").selectExpr("cast(t as timestamp) ts", "price", "quantity", "aggressorside").coalesce(1).write.parquet(str(tmp_path / "in"))
    from tickweave.streaming.replay import trade_buckets

    source = spark.readStream.schema("ts timestamp, price double, quantity double, aggressorside string").parquet(str(tmp_path / "in"))
    query = trade_buckets(source, "10 seconds", "1 second").writeStream.format("memory").queryName("flow").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("flow").orderBy("bucket").collect()
    assert [(r["trade_count"], r["trade_buy"], r["trade_sell"]) for r in got] == [(10, 5, 5)] * 3
