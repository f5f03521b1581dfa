import pytest
from pyspark.sql import functions as F

from tests.market import ns, write_log
from tickweave.plans.sessions import snapshot_pair
from tickweave.schemas import canonical_schema
from tickweave.sources import messages as src


def test_csv_header_decides_and_unknown_columns_are_dropped(spark, tmp_path):
    rows = [{"receipttimestamp": 10 + k, "f": "x", "side": "Bid", "price": 1.5, "quantity": 10, "orderreferencenumber": "9223372036854775815", "previousprice": "", "maintainpriority": "true", "admindelete": "", "JUNK1": "j", "JUNK2": 2} for k in range(80)]
    rows.append({"receipttimestamp": 99, "f": "x", "side": "", "price": "", "quantity": "", "orderreferencenumber": "<NA>", "JUNK1": "j", "JUNK2": 2})
    msgs, failures = src.messages(spark, write_log(tmp_path, "20250423", "SPY", {"mt_add_order": rows}), "20250423", "SPY", ["mt_add_order"])
    assert not failures and not any("junk" in c.lower() for c in msgs.columns)
    got = msgs.orderBy("ts_ns").collect()
    assert len(got) == 81 and got[0]["orderreferencenumber"] == "9223372036854775815"
    last = got[-1]
    assert last["side"] is None and last["price"] is None and last["quantity"] is None and last["orderreferencenumber"] is None


def test_sequence_column_is_kept_exactly(spark, tmp_path):
    big = 2**53 + 1
    rows = [{"receipttimestamp": 1, "sourcetimestamp": 2, "sequencenumber": big, "f": "x", "side": "Bid", "price": "NaN", "quantity": "7x", "orderreferencenumber": "ORD-A1B2", "previousorderreferencenumber": "", "somethingelse": 5}]
    root = write_log(tmp_path, "20250423", "SPY", {"mt_modify_order": rows})
    one = src.messages(spark, root, "20250423", "SPY", ["mt_modify_order"], "exchange")[0].first()
    assert one["sequencenumber"] == big and one["ts_ns"] == 2 and one["price"] is None and one["quantity"] is None
    events = src.replay_events(src.messages(spark, root, "20250423", "SPY", ["mt_modify_order"])[0]).first()
    assert events["prev_ref"] == "ORD-A1B2" and events["maintain"] is True and events["ts_ns"] == 1


def test_missing_type_fails_unless_told(spark, tmp_path):
    root = write_log(tmp_path, "20250423", "SPY", {"mt_add_order": [{"receipttimestamp": 1, "f": "x"}]})
    with pytest.raises(Exception):
        src.messages(spark, root, "20250423", "SPY", ["mt_add_order", "mt_trade"])
    msgs, failures = src.messages(spark, root, "20250423", "SPY", ["mt_add_order", "mt_trade"], on_missing="empty")
    assert list(failures) == ["mt_trade"] and msgs.count() == 1
    with pytest.raises(ValueError):
        src.messages(spark, root, "20250423", "SPY", ["mt_unknown"])


def test_session_window_is_closed(spark, tmp_path):
    date = "20240103"
    times = [ns(date, "09:30") - 1, ns(date, "09:30"), ns(date, "16:00"), ns(date, "16:00") + 1]
    msgs, _ = src.messages(spark, write_log(tmp_path, date, "SPY", {"mt_add_order": [{"receipttimestamp": t, "f": "x"} for t in times]}), date, "SPY", ["mt_add_order"])
    assert sorted(r["ts_ns"] for r in src.in_session(msgs, date, "09:30", "16:00").collect()) == times[1:3]


def test_saved_messages_read_back(spark, tmp_path):
    root = write_log(tmp_path / "log", "20240103", "SPY", {"mt_add_order": [{"receipttimestamp": 5, "f": "x", "price": 1.25}]})
    msgs, _ = src.messages(spark, root, "20240103", "SPY", ["mt_add_order"])
    src.save(msgs, str(tmp_path / "saved"))
    back = src.load(spark, str(tmp_path / "saved")).select(*msgs.columns)
    assert back.collect() == msgs.collect()


def snapshot_csv(path, prefix, levels=4, torn=True):
    names = ["time", f"{prefix}.mid", *(f"{prefix}.{n}{k}" for k in range(1, levels + 1) for n in ("bid", "bsize", "ask", "asize"))]
    lines = [",".join(names)]
    for t in range(60):
        row = [f"2020-03-12 09:{30 + t // 60:02d}:{t % 60:02d}", "550"]
        for k in range(1, levels + 1):
            bid = 5000 if t == 0 and k == 1 else 100
            ask_size = "" if torn and k == 2 and 40 <= t <= 55 else "100"
            row += [f"{550 - 0.01 * k:.2f}", str(bid), f"{550 + 0.01 * k:.2f}", ask_size]
        lines.append(",".join(row))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_snapshot_is_canonical_and_torn_levels_are_whole(spark, tmp_path):
    path = snapshot_csv(tmp_path / "s.csv", "direct")
    wide = src.snapshot(spark, path, "direct", "SPY", 4)
    rows = wide.collect()
    assert set(wide.columns) <= {f.name for f in canonical_schema("SPY", 4)} and len(rows) == 60
    assert F and rows[0]["ts"].strftime("%H:%M:%S") == "13:30:00"
    torn = [r for r in rows if r["SPY_askprice_2"] is None]
    assert len(torn) == 16 and all(r["SPY_askquantity_2"] is None and r["SPY_askprice_1"] and r["SPY_bidprice_2"] for r in torn)
    with pytest.raises(ValueError):
        src.snapshot(spark, path, "other", "SPY", 4)


def test_snapshot_pair_joins_on_time(spark, tmp_path):
    a, b = snapshot_csv(tmp_path / "a.csv", "direct"), snapshot_csv(tmp_path / "b.csv", "futures")
    pair = snapshot_pair(spark, [(a, "direct", "SPY", 1.0), (b, "futures", "ES", 10.0)], 4)
    row = pair.first()
    assert pair.count() == 60 and row["ES_bidprice_1"] == pytest.approx(10 * row["SPY_bidprice_1"])
