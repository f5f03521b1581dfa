"""The tape as a stream, and the book in its plainest form: a feed's whole book as one state.

``live`` is the form for large books and for event time; this one needs no particular state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickweave.operators.fold import Feed
from tickweave.operators.ordering import REMOVALS

LEVELS = "f string, side string, price double, seq long, arrival long, ts_ns long, level double, crossed boolean"


FIELDS = ["f", "code", "side", "price", "qty", "ref", "prev_ref", "maintain", "seq", "ts_ns", "arrival"]


class _Live:
    """One feed's book with its best prices, and the events that wait for earlier ones."""

    def __init__(self):
        self.feed, self.waiting = Feed(), []
        self.best: dict[str, float | None] = {"Bid": None, "Ask": None}

    def touched(self, side: str, price: float) -> None:
        """Keep the best price of a side; its levels are only searched when the best one goes."""
        best, here = self.best[side], (side, price) in self.feed.levels
        better = max if side == "Bid" else min
        if here:
            self.best[side] = price if best is None else better(best, price)
        elif price == best:
            self.best[side] = better((p for s, p in self.feed.levels if s == side), default=None)

    def crossed(self) -> bool:
        bid, ask = self.best["Bid"], self.best["Ask"]
        return bid is not None and ask is not None and bid > ask


def _applied(hold: int):
    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live: _Live = pickle.loads(state.get[0]) if state.exists else _Live()
        rows = pd.concat([pd.DataFrame(live.waiting, columns=FIELDS, dtype=object), *(x[FIELDS].astype(object) for x in frames)], ignore_index=True)
        rows["_elim"] = rows["code"].isin(REMOVALS)
        rows = rows.sort_values(["seq", "_elim", "arrival"], kind="stable", na_position="last")
        rows = rows.where(rows.notna(), None)
        ready = pd.Series(True, rows.index)
        if hold and rows["seq"].notna().any():
            ready = rows["seq"].notna() & (rows["seq"].astype(float) <= float(rows["seq"].dropna().max()) - hold)
        live.waiting = rows.loc[~ready, FIELDS].values.tolist()
        out = []
        for r in rows[ready].itertuples(index=False):
            for side, price in live.feed.apply(r)[0]:
                live.touched(side, price)
                out.append((r.f, side, price, r.seq, r.arrival, r.ts_ns, live.feed.levels.get((side, price), 0.0), live.crossed()))
        state.update((pickle.dumps(live),))
        yield pd.DataFrame(out, columns=["f", "side", "price", "seq", "arrival", "ts_ns", "level", "crossed"]).astype({"seq": "Int64"})

    return apply


def level_changes(events: DataFrame, hold: int = 0) -> DataFrame:
    """A stream of EVENTS -> each change of a level, with the feed's book as state.

    A feed's rows are applied in sequence order: within a trigger, and over triggers
    as far as ``hold`` reaches: an event waits until one of its feed comes that is ``hold``
    sequence numbers later (so a feed's last ones wait while it is silent). The state (resting
    orders, levels, waiting events) is kept by Spark's state store and recovered from it.
    """
    return events.groupBy("f").applyInPandasWithState(_applied(hold), LEVELS, "book binary", "append", GroupStateTimeout.NoTimeout)


def trade_buckets(trades: DataFrame, step: str, late: str = "10 seconds") -> DataFrame:
    """A stream of trades (ts, price, quantity, aggressorside) -> closed tumbling buckets; rows later than ``late`` are left out."""
    a = F.lower(F.trim("aggressorside"))
    q, p = F.col("quantity"), F.col("price")
    got = trades.withWatermark("ts", late).groupBy(F.window("ts", step)).agg(
        F.count(q).alias("trade_count"), F.sum(q).alias("trade_volume"), F.count(F.when(a == "buy", 1)).alias("trade_buy"),
        F.count(F.when(a == "sell", 1)).alias("trade_sell"), F.try_divide(F.sum(p * q), F.sum(F.when(p.isNotNull(), q))).alias("trade_vwap"),
    )
    return got.select(F.col("window.start").alias("bucket"), "trade_count", "trade_volume", "trade_buy", "trade_sell", "trade_vwap")
