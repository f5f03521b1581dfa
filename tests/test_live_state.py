"""The live book's use of the state store: how often it is asked, pages that grow, blocks, what waits over triggers."""

import random
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_book import stream
from tickweave import market_queries
from tickweave.operators.fold import fold_feed
from tickweave.operators.ordering import REMOVALS
from tickweave.schemas import EVENTS
from tickweave.streaming import live

SECOND = 10**9


class Store:
    """The maps and values of one feed, in memory; calls are counted."""

    def __init__(self):
        self.maps, self.calls, self.timers = {}, 0, set()

    def getMapState(self, name, *_):  # noqa: N802
        held = self.maps.setdefault(name, {})

        def counted(f):
            def call(*args):
                self.calls += 1
                return f(*args)

            return call

        calls = {"getValue": held.get, "updateValue": held.__setitem__, "removeKey": held.__delitem__, "containsKey": held.__contains__}
        return SimpleNamespace(iterator=lambda: iter(list(held.items())), **{k: counted(f) for k, f in calls.items()})

    def getValueState(self, name, *_):  # noqa: N802
        held = self.maps.setdefault(name, {})
        return SimpleNamespace(get=lambda: held.get(0), update=lambda v: held.__setitem__(0, v))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


def fed(store, rows, watermark_ms, step_ms=1000):
    """One trigger: rows come, then the watermark passes; the process starts anew. Its rows."""
    book = live.LiveBook(step_ms)
    book.init(store)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
    df = pd.DataFrame(rows, columns=EVENTS.names)
    out = list(book.handleInputRows(("A",), iter([df[k : k + 40] for k in range(0, len(df), 40)]), now))
    while due := [t for t in store.timers if t <= watermark_ms]:
        store.timers -= set(due)
        out += book.handleExpiredTimer(("A",), now, SimpleNamespace(getExpiryTimeInMs=lambda: max(due)))
    return pd.concat(out) if out else live.told([])


def events(seed, n):
    """One feed, all with a sequence; clocks go back by up to two seconds."""
    rng = random.Random(seed)
    rows = [("A", *r[1:8], k, 1000 * SECOND + k * SECOND // 4 + rng.randint(0, 2 * SECOND), k) for k, r in enumerate(r for r in stream(rng, n) if r[2] != "?")]
    return rows


def wanted(rows):
    df = pd.DataFrame(rows, columns=EVENTS.names)
    df = df.assign(k1=df["seq"], k2=df["code"].isin(REMOVALS).astype("int64")).sort_values(["k1", "k2", "arrival"])
    got = fold_feed(df.assign(eff_ts=df["ts_ns"].cummax()))
    return got[["arrival", "side", "price", "eff_ts", "level"]].values.tolist()


def test_the_store_is_not_asked_event_by_event():
    """Twice the events of the same orders and blocks: not more calls, and fewer than events."""
    calls = []
    for n in (4000, 8000):
        rows = [("A", "ADD" if k % 2 else "CANCEL", "Bid", float(1 + k // 2 % 60), 5.0, str(k // 2 % 60), None, True, k, 1000 * SECOND + k, k) for k in range(n)]
        store = Store()
        assert len(fed(store, rows, 10**7)) > n // 2
        calls.append(store.calls)
    assert calls[1] <= calls[0] + 10 and calls[1] < 200


@pytest.mark.parametrize("seed", range(4))
def test_small_pages_and_blocks_equal_the_fold(monkeypatch, seed):
    """Pages are cut, the book leaves memory, blocks and triggers are many."""
    for name, n in {"PAGE": 2, "BLOCK": 16, "TOGETHER": 50, "HELD": 6}.items():
        monkeypatch.setattr(live, name, n, raising=False)
    rows = events(seed, 600)
    sent = sorted(rows, key=lambda r: r[9])
    store, out = Store(), []
    for k in range(0, len(sent), 60):
        part = sent[k : k + 60]
        random.Random(k).shuffle(part)
        out.append(fed(store, part, sent[min(k + 60, len(sent) - 1)][9] // 10**6 - 3000))
    assert sum(map(len, out[:5])) > 0
    out.append(fed(store, [], 10**9))
    got = pd.concat(out)
    assert set(got["kind"]) == {"level"}
    assert got[["arrival", "side", "price", "eff_ts", "level"]].astype(object).values.tolist() == wanted(rows)
    assert not store.maps["pieces"] and not store.maps["blocks"] and store.maps["state"][0][6] > 1


def test_rows_as_the_watermark_passes_without_a_sequence(monkeypatch):
    """They go by clock, after those of their grid point that have one; one that comes twice while it waits counts once."""
    monkeypatch.setattr(live, "TOGETHER", 1, raising=False)
    add = lambda k, seq, t: ("A", "ADD", "Bid", 1.0, 2.0, f"r{k}", None, True, seq, t * SECOND, k)
    level = ("A", "LEVEL_SET", "Bid", 1.0, 9.0, None, None, True, 1, 100 * SECOND, 7)
    store = Store()
    got = fed(store, [add(4, None, 103), add(3, None, 102), add(2, 2, 101), add(9, None, 140), level, level], 110_000)
    assert got[["arrival", "eff_ts", "level"]].astype(object).values.tolist() == [[7, 100 * SECOND, 9.0], [2, 101 * SECOND, 11.0], [3, 102 * SECOND, 13.0], [4, 103 * SECOND, 15.0]]
    assert got["seq"].isna().tolist() == [False, False, True, True]
    assert fed(store, [], 150_000)["level"].tolist() == [17.0]


def test_times_that_start_anew_are_waited_for(spark, tmp_path):
    """The events twice, keys shifted and times not: the second half is as old as the first, and none is left out."""
    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one.unionByName(one.withColumns({"event_id": F.col("event_id") + 1000, "user_id": F.col("user_id") + 1500})).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = market_queries.stream_levels(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = db.execute(market_queries.ORACLES["stream_levels"])
    names = [d[0] for d in got.description]
    assert sorted(tuple(r) for r in df.select(names).collect()) == sorted(got.fetchall())
