"""The book as a stream with its state in Spark's state store, in pages of orders and levels and blocks of events.

A feed's state is three maps: resting orders by reference and levels by (side, price), both in
pages of about PAGE entries (by a hash of the key; the pages grow in number with the book), and events
that wait, in blocks of BLOCK sequence numbers. Only the pages and blocks that are touched are read and
written back, so a trigger costs what its events cost, however large the book is; and the
store is asked once a page or block, not once an event. A block is the most that is held at a time,
beside HELD entries of the book.

Events wait until the grid point at or after their time is passed by the watermark; then
a timer applies them in the feed's own sequence (all that are due at once, and sets itself to
the next point that is waited for). As in the batch replay, an event is visible when
the greatest clock up to it in sequence order is reached: one that waits for a point holds back those
that follow it. Events older than the watermark do not reach the book (Spark counts them in
``numRowsDroppedByWatermark``); one that comes after a later one of its feed has been applied
is not applied either, and is told as a row of kind ``late``.

Events without a sequence number follow those of their grid point that have one, by
clock. What waits when a stream ends is applied when time moves on: a row with the code
END (of any feed) and a later time is enough.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickweave.operators.fold import Feed
from tickweave.operators.ordering import REMOVALS

CHANGES = "f string, kind string, side string, price double, seq long, arrival long, eff_ts long, level double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["code", "side", "price", "qty", "ref", "prev_ref", "maintain", "ts_ns"]
#: An event as it is applied.
Waited = namedtuple("Waited", FIELDS)
#: Events that wait: their order is (unordered, at, elim, arrival); unordered is of the block.
WAITING = pa.schema([("at", pa.int64()), ("elim", pa.int8()), ("arrival", pa.int64()), *[(n, pa.string()) for n in ("code", "side", "ref", "prev_ref")], ("price", pa.float64()), ("qty", pa.float64()), ("maintain", pa.bool_()), ("ts_ns", pa.int64())])
#: Entries in a page, about; sequence numbers in a block; events put to wait together; entries of the book in memory.
PAGE, BLOCK, TOGETHER, HELD = 100, 1 << 16, 250_000, 1_000_000


class Pages:
    """A map of the state store in pages: those of fetch()ed keys are in the dict ``held`` until save() writes them back."""

    def __init__(self, state, pages: int):
        self.state, self.pages = state, pages
        self.held: dict = {}
        self.fetched: set[int] = set()

    def page(self, k) -> int:
        # A price of -0.0 equals 0.0 as a key.
        return crc32((k if isinstance(k, str) else f"{k[0]} {k[1] + 0.0}").encode()) % self.pages

    def read(self, n: int) -> dict:
        found = self.state.getValue((n,))
        return {} if found is None else pickle.loads(found[0])

    def fetch(self, keys: Iterable) -> None:
        for n in {self.page(k) for k in keys} - self.fetched:
            self.held.update(self.read(n))
            self.fetched.add(n)

    def write(self, entries: dict, pages: Iterable[int]) -> None:
        """entries are all that these pages hold."""
        by: dict[int, dict] = {n: {} for n in pages}
        for k, v in entries.items():
            by[self.page(k)][k] = v
        for n, its in by.items():
            if its:
                self.state.updateValue((n,), (pickle.dumps(its),))
            elif self.state.containsKey((n,)):
                self.state.removeKey((n,))

    def save(self) -> None:
        before, times = self.pages, 1
        if len(self.held) > 2 * PAGE * len(self.fetched):
            while len(self.held) > PAGE * len(self.fetched) * times:
                times *= 2
        self.pages = before * times  # a power of two: page n is cut into n, n + before, ..
        parts = lambda n: range(n, self.pages, before)
        if times > 1:
            for n in set(range(before)) - self.fetched:
                self.write(self.read(n), parts(n))
        self.write(self.held, [p for n in self.fetched for p in parts(n)])
        self.held.clear()
        self.fetched.clear()


class LiveBook(StatefulProcessor):
    """The book of one feed; ``step_ms`` is the grid of its timers."""

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("order_pages", "page int", "entries binary")
        self.levels = handle.getMapState("level_pages", "page int", "entries binary")
        # A block is of sequence numbers or, without them, a grid point; its events lie in pieces as they came.
        self.blocks = handle.getMapState("blocks", "unordered int, block long", "pieces int")
        self.waiting = handle.getMapState("pieces", "unordered int, block long, piece int", "events binary")
        self.about = handle.getValueState("state", "shows_levels boolean, unordered int, at long, elim int, arrival long, eff_ts long, order_pages int, level_pages int")

    def known(self) -> tuple:
        """(whether price levels were shown, order of the last event applied or None, its effective time, pages of orders, of levels)."""
        got = self.about.get()
        return (False, None, -(1 << 62), 1, 1) if got is None else (got[0], None if got[1] < 0 else tuple(got[1:5]), got[5], got[6], got[7])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, last, eff, *_ = self.known()
        first, n, frames = None, 0, []
        for pdf in rows:
            pdf = pdf[pdf["code"] != "END"]  # its time alone counts, and Spark has seen that
            ts, arrival = pdf["ts_ns"].to_numpy("int64"), pdf["arrival"].to_numpy("int64")
            ordered = pdf["seq"].notna().to_numpy()
            at = np.where(ordered, pdf["seq"].where(ordered, 0).to_numpy("int64"), ts)
            elim = pdf["code"].isin(REMOVALS).to_numpy("int8")
            if last is not None:
                _, a, e, r = last
                late = ordered & ((at < a) | ((at == a) & ((elim < e) | ((elim == e) & (arrival < r)))))
                if late.any():
                    yield told([(key[0], "late", side, price, seq, k, eff, None) for side, price, seq, k in zip(pdf["side"][late], pdf["price"][late], at[late].tolist(), arrival[late].tolist(), strict=True)])
                pdf, ts, arrival, ordered, at, elim = (x[~late] for x in (pdf, ts, arrival, ordered, at, elim))
            if not len(pdf):
                continue
            points = self.point(ts)
            first = int(points.min()) if first is None else min(first, int(points.min()))
            got = pdf[["code", "side", "ref", "prev_ref", "price", "qty"]].assign(at=at, elim=elim, arrival=arrival, maintain=pdf["maintain"].eq(True), ts_ns=ts)
            frames.append((~ordered, np.where(ordered, at // BLOCK, points), pa.Table.from_pandas(got, WAITING, preserve_index=False)))
            n += len(got)
            if n >= TOGETHER:
                self.wait(frames)
                n, frames = 0, []
        if frames:
            self.wait(frames)
        if first is not None:  # one timer is enough: when it fires, it sets the next
            self.handle.registerTimer(first)

    def wait(self, frames: list[tuple]) -> None:
        """Put events to wait: (unordered, block, their rows)."""
        unordered, block = (np.concatenate([x[k] for x in frames]) for k in (0, 1))
        rows = pa.concat_tables([x[2] for x in frames])
        by = np.lexsort((block, unordered))
        rows, unordered, block = rows.take(by), unordered[by], block[by]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (unordered[1:] != unordered[:-1])])
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            at = (int(unordered[a]), int(block[a]))
            found = self.blocks.getValue(at)
            self.put(at, 0 if found is None else found[0], rows.slice(a, b - a))

    def put(self, at: tuple, piece: int, rows: pa.Table) -> None:
        self.waiting.updateValue((*at, piece), (packed(rows),))
        self.blocks.updateValue(at, (piece + 1,))

    def taken(self, at: tuple, pieces: int) -> pa.Table:
        """The events of a block in their order; they wait no longer."""
        rows = pa.concat_tables([unpacked(self.waiting.getValue((*at, k))[0]) for k in range(pieces)])
        for k in range(pieces):
            self.waiting.removeKey((*at, k))
        self.blocks.removeKey(at)
        order = [rows[c].to_numpy() for c in ("arrival", "elim", "at")]
        by = np.lexsort(order)
        # One that came again while it waited is there once, as it came last.
        again = np.logical_and.reduce([c[by][1:] == c[by][:-1] for c in order])
        return rows.take(by[np.r_[~again, True]])

    def point(self, ts_ns):
        """The grid point at or after a time, in milliseconds."""
        return -(-ts_ns // (self.step_ms * 1_000_000)) * self.step_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # All points that the watermark has passed are dealt with together.
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        point = passed // self.step_ms * self.step_ms
        shows, last, eff, *pages = self.known()
        orders, levels = Pages(self.orders, pages[0]), Pages(self.levels, pages[1])
        feed = Feed()
        feed.shows_levels, feed.orders, feed.levels = shows, orders.held, levels.held
        ahead, held = [], False
        for at, pieces in sorted((tuple(k), v[0]) for k, v in self.blocks.iterator()):
            if at[0] and at[1] > point:
                ahead.append(at[1])
                break  # as are those that follow
            if not at[0] and held:
                continue
            rows = self.taken(at, pieces)
            ts = rows["ts_ns"].to_numpy()
            wait = np.flatnonzero(ts > point * 1_000_000)
            if len(wait):  # ordered: the first holds back those that follow it in sequence
                held = True
                ahead.append(self.point(int(ts[wait[0]])))
                self.put(at, 0, rows.slice(wait[0]))
                rows, ts = rows.slice(0, wait[0]), ts[: wait[0]]
                if not len(ts):
                    continue
            seen = ts if at[0] else np.maximum(np.maximum.accumulate(ts), eff)
            eff = max(eff, int(ts.max()))
            yield from self.applied(key[0], feed, orders, levels, rows, at[0], seen.tolist())
            if not at[0]:
                last = (0, *(rows[c][-1].as_py() for c in ("at", "elim", "arrival")))
            if len(orders.held) + len(levels.held) > HELD:
                orders.save()
                levels.save()
        orders.save()
        levels.save()
        if ahead:
            self.handle.registerTimer(max(min(ahead), point + self.step_ms))
        self.about.update((feed.shows_levels, *(last or (-1, 0, 0, 0)), eff, orders.pages, levels.pages))

    def applied(self, f, feed: Feed, orders: Pages, levels: Pages, rows: pa.Table, unordered: int, seen: list) -> Iterator[pd.DataFrame]:
        """The changes that these events make; what they touch of the book is fetched before."""
        columns = {c: values(rows[c]) for c in FIELDS}
        refs = {*columns["ref"], *columns["prev_ref"]} - {None}
        orders.fetch(refs)
        prices = {p for p in columns["price"] if p is not None}
        levels.fetch({(side, p) for side in ("Bid", "Ask") for p in prices} | {orders.held[r][:2] for r in refs if r in orders.held})
        out = []
        for event, at, arrival, eff in zip(map(Waited._make, zip(*columns.values(), strict=True)), values(rows["at"]), values(rows["arrival"]), seen, strict=True):
            for side, price in feed.apply(event)[0]:
                out.append((f, "level", side, price, None if unordered else at, arrival, eff, levels.held.get((side, price), 0.0)))
        yield told(out)

    def close(self) -> None:
        pass


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(stored))).read_all()


def values(column: pa.ChunkedArray) -> list:
    """to_pylist(), faster."""
    got = column.to_numpy()
    if column.null_count and got.dtype != object:
        got = got.astype(object)
        got[column.is_null().to_numpy()] = None
    return got.tolist()


def told(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split(" ")[0] for c in CHANGES.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"f": object, "kind": object, "side": object, "price": "float64", "seq": "Int64", "arrival": "Int64", "eff_ts": "Int64", "level": "float64"})


def live_levels(events: DataFrame, step_ms: int, late: str) -> DataFrame:
    """A stream of EVENTS -> changes of levels (kind ``level``) and events that came too late for their feed (``late``).

    late: how far behind the latest event one may be (the watermark); step_ms: the grid at whose points
    waiting events are applied.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the only store with maps and timers
    timed = events.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", late)
    return timed.groupBy("f").transformWithStateInPandas(statefulProcessor=LiveBook(step_ms), outputStructType=CHANGES, outputMode="append", timeMode="EventTime")
