"""The live book: restarts, waiting, late events, events without a sequence."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_book import stream
from tickweave.operators.fold import fold_book
from tickweave.operators.ordering import ordered_events
from tickweave.schemas import EVENTS
from tickweave.streaming.live import live_levels

SECOND = 10**9


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, late="10 seconds", step_ms=1000):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = live_levels(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), step_ms, late)
        query = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped = sum(op["numRowsDroppedByWatermark"] for p in map(dict, query.recentProgress) for op in p["stateOperators"])
        return spark.read.parquet(str(tmp_path / "out")), dropped

    return go


def end(at):
    return [("A", "END", None, None, None, None, None, True, None, at, None)]


def add(k, seq, t, f="A", code="ADD", price=1.0, qty=2.0, ref=None):
    return (f, code, "Bid", price, qty, ref or f"r{k}", ref or f"r{k}", True, seq, t * SECOND, k)


def test_three_runs_equal_the_batch_replay(spark, run):
    rng = random.Random(6)
    rows = [(*r[:9], 1000 * SECOND + r[10] * SECOND // 4 + rng.randint(0, 2 * SECOND), r[10]) for r in stream(rng, 150) if r[8] is not None and r[2] != "?"]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[9] // (6 * SECOND))  # out of order within six seconds
    out = None
    for part in (rows[:50], rows[50:100], rows[100:] + end(10_000 * SECOND)):
        out, dropped = run(part)
        assert not dropped
    key = ["f", "arrival", "side", "price"]
    got = out.where("kind = 'level'").select(*key, "eff_ts", "level").distinct().toPandas().set_index(key).sort_index()
    ordered = ordered_events(spark.createDataFrame(rows, EVENTS))
    want = fold_book(ordered).select(*key, "eff_ts", "level").distinct().toPandas().set_index(key).sort_index()
    assert len(got) and got["level"].to_dict() == pytest.approx(want["level"].to_dict()) and got["eff_ts"].to_dict() == want["eff_ts"].to_dict()
    assert out.where("kind = 'late'").isEmpty()


def test_late_events_are_told_and_not_applied(run):
    out, _ = run([add(1, 1, 100), add(3, 3, 101)])
    run([add(9, 9, 130)])  # the watermark passes 1 and 3
    out, dropped = run([add(2, 2, 125), add(4, 4, 50), *end(1000 * SECOND)])  # 2: in time by the clock, but 3 is applied; 4: older than the watermark
    assert dropped == 1
    rows = {(r["kind"], r["arrival"]): r["level"] for r in out.collect()}
    assert rows == {("level", 1): 2.0, ("level", 3): 4.0, ("late", 2): None, ("level", 9): 6.0}


def test_a_later_clock_holds_back_its_followers_and_unordered_events_go_by_clock(run):
    out, _ = run([add(1, 1, 100), add(2, 2, 109), add(3, 3, 101), add(5, None, 103, "B"), add(4, None, 102, "B"), *end(1000 * SECOND)])
    got = {r["arrival"]: (r["eff_ts"] // SECOND, r["level"]) for r in out.collect()}
    assert got == {1: (100, 2.0), 2: (109, 4.0), 3: (109, 6.0), 4: (102, 2.0), 5: (103, 4.0)}


def test_state_survives_removals(run):
    run([add(1, 1, 100), add(2, 2, 101), *end(200 * SECOND)])
    out, _ = run([add(3, 3, 300, code="CANCEL", ref="r1"), add(4, 4, 301, code="TRADE", ref="r2", qty=0.5), add(5, 5, 302, code="TRADE", ref="gone", qty=0.5), *end(1000 * SECOND)])
    assert out.where(F.col("arrival") >= 3).orderBy("arrival").select("arrival", "level").toPandas().values.tolist() == [[3, 2.0], [4, 1.5], [5, 1.0]]
