"""The sequential book: one feed's events applied one after the other.

The plain statement of the rules: tests hold the windows against it, and the
streaming book applies it event by event.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from tickweave.operators.ordering import ORDER

EPS = 1e-9
SCHEMA = "f string, side string, price double, k1 long, k2 long, arrival long, sub int, eff_ts long, level double, matched boolean, code string"


class Feed:
    """Resting orders (reference -> side, price, size) and levels (side, price -> size) of one feed."""

    def __init__(self):
        self.orders: dict[str, tuple[str, float, float]] = {}
        self.levels: dict[tuple[str, float], float] = {}
        self.shows_levels = False

    def resize(self, ref, after: float) -> list:
        """A resting order changes to size ``after`` (0: it leaves), its level by the difference; what leaves takes an empty level with it."""
        if ref not in self.orders:
            return []
        side, price, before = self.orders.pop(ref)
        level = self.levels.get((side, price), 0.0) + after - before
        if after > 0:
            self.orders[ref] = (side, price, after)
        if after > 0 or level > EPS:
            self.levels[side, price] = level
        else:
            self.levels.pop((side, price), None)
        return [[side, price]]

    def add(self, ref, side, price, size) -> list:
        if side not in ("Bid", "Ask") or not all(x is not None and math.isfinite(x) for x in (price, size)) or size <= 0 or ref is None:
            return []
        touched = self.resize(ref, 0.0)
        self.orders[ref] = (side, price, size)
        self.levels[side, price] = self.levels.get((side, price), 0.0) + size
        return [*touched, [side, price]]

    def take(self, ref, qty) -> list:
        left = self.orders[ref][2] - qty if ref in self.orders else 0.0
        return self.resize(ref, left if left > EPS else 0.0)

    def take_at(self, price, qty) -> list:
        have = [s for s in ("Bid", "Ask") if (s, price) in self.levels]
        if price is None or not math.isfinite(price) or not have:
            return []
        side = have[0] if len(have) == 1 else "Ask"
        if qty >= self.levels[(side, price)] - EPS:
            self.levels.pop((side, price))
        else:
            self.levels[(side, price)] -= qty
        return [[side, price]]

    def assign(self, side, price, qty) -> list:
        self.shows_levels = True
        if side not in ("Bid", "Ask") or price is None:
            return []
        if qty is None or not math.isfinite(qty) or qty <= EPS:
            self.levels.pop((side, price), None)
        else:
            self.levels[(side, price)] = qty
        return [[side, price]]

    def apply(self, r) -> tuple[list, bool]:
        """(levels touched, whether a removal or trade met its order)."""
        qty = 0.0 if r.qty is None or r.qty != r.qty else r.qty
        if r.code == "ADD":
            return self.add(r.ref, r.side, r.price, r.qty), True
        if r.code == "CANCEL":
            out = self.resize(r.ref, 0.0)
            return out, bool(out)
        if r.code == "TRADE":
            out = self.take(r.ref, qty)
            if out or self.shows_levels:
                return out, bool(out)
            return self.take_at(r.price, qty), False
        if r.code == "MODIFY":  # the old one leaves (if it is gone, the one of the new name), the new one comes
            return (self.resize(r.prev_ref, 0.0) or self.resize(r.ref, 0.0)) + self.add(r.ref, r.side, r.price, r.qty), True
        return self.assign(r.side, r.price, r.qty if r.code == "LEVEL_SET" else 0.0), True


def fold_feed(pdf: pd.DataFrame) -> pd.DataFrame:
    book, out = Feed(), []
    rows = pdf.sort_values(ORDER, kind="stable").astype({"price": object, "qty": object})
    rows = rows.where(rows.notna(), None)
    for r in rows.itertuples(index=False):
        touched, matched = book.apply(r)
        for sub, (side, price) in enumerate(touched):
            out.append((r.f, side, price, r.k1, r.k2, r.arrival, sub, r.eff_ts, book.levels.get((side, price), 0.0), matched, r.code))
    return pd.DataFrame(out, columns=["f", "side", "price", *ORDER, "sub", "eff_ts", "level", "matched", "code"])


def fold_book(ordered: DataFrame) -> DataFrame:
    """The same level changes as ``book.levels``, by one sequential pass over each feed."""
    return ordered.groupBy("f").applyInPandas(fold_feed, SCHEMA)
