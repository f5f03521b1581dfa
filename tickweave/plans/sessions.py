"""Sessions of several assets: replay, join, trade flow, for many dates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.calendar import MONTH_CODES, QUARTERLY, default_lot
from tickweave.operators import book, ladder, trades
from tickweave.operators.ordering import coverage, ordered_events
from tickweave.schemas import MESSAGE_TYPES
from tickweave.sources import lake as lakes
from tickweave.sources import messages as src
from tickweave.staging import new_path, staged

ORDER_TYPES = ["mt_add_order", "mt_cancel_order", "mt_modify_order", "mt_trade"]
LEVEL_TYPES = ["mt_price_level_update", "mt_modify_price_level", "mt_delete_price_level"]


@dataclass(frozen=True)
class Asset:
    """One instrument of a session: its product (a symbol for futures) and how its book is read."""

    product: str
    product_type: str = "direct"  # or "futures"
    price_scale: float = 1.0
    types: list[str] = field(default_factory=lambda: [*ORDER_TYPES, *LEVEL_TYPES])
    sign: str = "aggressor"

    def __post_init__(self):
        default_lot(self.product_type)  # raises on an unknown type

    @property
    def root(self) -> str:
        return self.product.upper()


def third_friday_of(year: int, month: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta((4 - first.weekday()) % 7 + 14)


def contract_of(symbol: str, date: dt.date, rollover_days: int = 8) -> str:
    """The front contract on a date."""
    for year in (date.year, date.year + 1):
        for code in QUARTERLY:
            if date <= third_friday_of(year, MONTH_CODES[code]) - dt.timedelta(rollover_days):
                return f"{symbol}{code}{year % 10}"
    raise ValueError(date)


def parse_date(text: str) -> dt.date:
    return dt.datetime.strptime(text, "%Y%m%d").date()


def micros(date: str, clock: str, tz: str) -> int:
    """Epoch microseconds of a local time."""
    day = parse_date(date)
    h, m = map(int, clock.split(":"))
    return int(dt.datetime(day.year, day.month, day.day, h, m, tzinfo=ZoneInfo(tz)).timestamp()) * 1_000_000


@dataclass(frozen=True)
class Window:
    """A session's grid: closed at both ends."""

    start: str = "09:30"
    end: str = "16:00"
    step_s: int = 1
    tz: str = "America/New_York"

    def of(self, date: str) -> tuple[int, int, int]:
        """(first point in epoch microseconds, step in microseconds, points)."""
        g0, g1 = micros(date, self.start, self.tz), micros(date, self.end, self.tz)
        return g0, self.step_s * 1_000_000, (g1 - g0) // (self.step_s * 1_000_000) + 1


def infer_date(msgs: DataFrame, tz: str = "America/New_York") -> str:
    """YYYYMMDD of the first event's local date."""
    return msgs.agg(F.date_format(F.from_utc_timestamp(F.min("ts"), tz), "yyyyMMdd")).first()[0]


@dataclass(frozen=True)
class Plan:
    """The sessions of one run: what (date, product) they read, and how. ``s`` = number of the date * assets + number of the asset."""

    dates: list[tuple[str, str]]
    assets: list[Asset]
    window: Window

    def rows(self) -> list[tuple]:
        """(s, k, a, session_date, product, g0_us, lot, scale)."""
        out = []
        for k, (date, _) in enumerate(self.dates):
            for a, asset in enumerate(self.assets):
                product = contract_of(asset.product, parse_date(date)) if asset.product_type == "futures" else asset.product
                out.append((k * len(self.assets) + a, k, a, date, product, self.window.of(date)[0], default_lot(asset.product_type), asset.price_scale))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """rows() as a table: as many as the caller has named, so it is broadcast."""
        return F.broadcast(spark.createDataFrame(self.rows(), "s int, k int, a int, session_date string, product string, g0_us long, lot double, scale double"))

    def wanted(self, types) -> list[tuple[int, str, str, str]]:
        """(s, session_date, product, message type) that are read; types: of an asset."""
        return [(r[0], r[3], r[4], t) for r in self.rows() for t in types(self.assets[r[2]])]

    @property
    def step_us(self) -> int:
        return self.window.step_s * 1_000_000

    @property
    def points(self) -> int:
        found = {self.window.of(date)[2] for date, _ in self.dates}
        if len(found) > 1:
            raise ValueError("sessions of different lengths (a change of the clock within one)")
        return found.pop()


BREAKS = ["mt_trade_break", "mt_trade_correction"]


def landed(spark: SparkSession, root: str, plan: Plan, fmt: str, lake: str | None, with_flow: bool) -> tuple[str, DataFrame]:
    """(the lake that has the plan's logs, what of them is absent). Logs are landed by one stream; an earlier lake takes only new files."""
    path = lake or new_path(spark, "lake")
    lakes.land(spark, root, path, f"{path}-taken", [f"{r[3]}/{r[4]}" for r in plan.rows()], fmt)
    needed = sorted({w[1:] for w in plan.wanted(lambda a: [*a.types, *(["mt_trade"] if with_flow else [])])})
    return path, lakes.failures(spark, path, needed)


def read_plan(spark: SparkSession, lake: str, plan: Plan, types, clock: str) -> DataFrame:
    """Messages of all sessions with s and the rest of the plan's columns: one scan of the partitions that are named."""
    wanted = plan.wanted(types)
    pick = F.broadcast(spark.createDataFrame(wanted, "s int, session_date string, product string, message_type string"))  # sessions x types
    msgs = lakes.read(spark, lake, *[[w[k] for w in wanted] for k in (1, 2, 3)], clock=clock)
    return msgs.join(pick, ["session_date", "product", "message_type"]).join(plan.table(spark).drop("session_date", "product"), "s")


def replayed_books(spark: SparkSession, lake: str, plan: Plan, depth: int, round_lot: float | None = None, odd_lots: bool = True, clock: str = "receipt", order_by: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """((k, gi, all assets' books), statistics by s) of all sessions, replayed together.

    A feed of a session is its own key (s, f), so nothing in the replay knows how many
    sessions there are: the jobs are those of one.
    """
    msgs = read_plan(spark, lake, plan, lambda a: a.types, clock).where("f is not null")
    keyed = msgs.withColumn("f", F.struct("s", "f"))
    events = src.replay_events(keyed, F.col("scale"))
    ordered = staged(ordered_events(events, order_by), "ordered")
    life = staged(book.lifecycle(ordered), "lifecycle")
    of_s = plan.table(spark).select("s", (F.col("g0_us") * 1000).alias("g0_ns"), "lot")
    changes = book.levels(ordered, life).withColumn("s", F.col("f.s")).join(of_s, "s")
    cut = ladder.intervals(changes, "g0_ns", plan.step_us * 1000, plan.points)
    spans = staged(cut.withColumn("s", F.col("f.s")), "spans").join(of_s.drop("g0_ns"), "s")
    lot = F.col("lot") if round_lot is None else F.lit(round_lot)
    n = len(plan.assets)
    placed = lambda df: df.withColumns({"k": F.expr(f"s div {n}").cast("int"), "a": F.col("s") % n})
    rows, best = placed(ladder.ladder(spans, depth, lot, odd_lots, ["s"])), placed(ladder.nbbo(spans, lot, ["s"]))
    cells, tops = [], []
    for a, asset in enumerate(plan.assets):
        own = F.col("a") == a
        cells += ladder.book_cells(asset.root, depth, own)
        tops += [F.max(F.when(own, F.col(f"nbbo_{side}"))).alias(f"{asset.root}_nbbo_{side}") for side in ("bid", "ask")]
    full = plan.table(spark).select("k").distinct().withColumn("gi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.points - 1).cast("long"))))
    wide = full.join(rows.groupBy("k", "gi").agg(*cells), ["k", "gi"], "left").join(best.groupBy("k", "gi").agg(*tops), ["k", "gi"], "left")
    by_s = F.col("f.s").alias("s")
    rates = ladder.crossed_rate(spans, plan.points, lot, odd_lots, ["s"])
    stats = book.replay_stats(ordered, life, by_s).join(rates, "s", "left").join(coverage(ordered, [by_s]).select("s", "warning"), "s", "left")
    return wide.fillna(0.0, [c for c in wide.columns if "quantity" in c]), stats.fillna(0, ["crossed", "locked_or_crossed", "rate"]).fillna(plan.points, ["points"])


def flows(spark: SparkSession, lake: str, plan: Plan, clock: str = "receipt") -> DataFrame:
    """k, ts_us and all assets' trade flow: scrubbed and signed trades of all sessions by bucket of the grid's step."""
    msgs = read_plan(spark, lake, plan, lambda a: ["mt_trade", *BREAKS], clock)
    end = (F.col("g0_us") + plan.step_us * (plan.points - 1)) * 1000
    tape = msgs.where("message_type = 'mt_trade'").where(F.col("ts_ns").between(F.col("g0_us") * 1000, end))
    breaks, corrections = (msgs.where(F.col("message_type") == t) for t in BREAKS)
    clean = trades.printable_only(trades.scrub(tape, breaks, corrections, by=["s"])).withColumn("ts_us", F.expr("ts_ns div 1000"))
    order, how = ["ts_ns", "arrival"], [(F.col("a") == a, asset.sign) for a, asset in enumerate(plan.assets)]
    signed = trades.signed(clean, order, F.expr("ts_ns div 600000000000"), how, by=["s"])
    buckets = trades.trade_buckets(signed, plan.step_us, order, tz=plan.window.tz, by=["k", "a"])
    return trades.flow_wide(buckets, [(x.root, F.col("a") == a, x.price_scale) for a, x in enumerate(plan.assets)], ["k"]).withColumnRenamed("bucket_us", "ts_us")


def extract_sessions(spark: SparkSession, root: str, dates: list[tuple[str, str]], assets: list[Asset], depth: int = 10, window: Window = Window(), with_flow: bool = True, clock: str = "receipt", fmt: str = "csv", order_by: str = "sequence", on_missing: str = "fail", lake: str | None = None, round_lot: float | None = None, odd_lots: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """((session_date, regime, ts, all assets' columns), statistics) for (date, regime) pairs.

    One plan for all sessions: they are landed by one stream, read by one scan and replayed
    together, so the number of jobs does not depend on theirs; rows are in the order of
    ``dates``, then time. ``lake``: a lake that stays; else one is made for the run.
    Message types that a session should have and has not are an error; with ``on_missing``
    "empty" the statistics name them (``absent``).
    """
    plan = Plan(dates, assets, window)
    path, absent = landed(spark, root, plan, fmt, lake, with_flow)
    if on_missing != "empty" and (some := absent.orderBy("session_date", "product", "message_type").take(5)):
        raise FileNotFoundError(f"no messages: {[tuple(r)[:3] for r in some]}")
    wide, stats = replayed_books(spark, path, plan, depth, round_lot, odd_lots, clock, order_by)
    wide = wide.join(plan.table(spark).where("a = 0").select("k", "session_date", "g0_us"), "k").withColumn("ts_us", F.col("g0_us") + F.col("gi") * plan.step_us)
    columns = [c for a in assets for c in (*ladder.book_names(a.root, depth), ladder.book_mid(a.root), f"{a.root}_nbbo_bid", f"{a.root}_nbbo_ask")]
    if with_flow:
        wide = wide.join(flows(spark, path, plan, clock), ["k", "ts_us"], "left").fillna(0, trades.flow_count_columns([a.root for a in assets]))
        columns += [f"{a.root}_{n}" for a in assets for n in trades.FLOW.values()]
    regime = F.element_at(F.array(*[F.lit(r) for _, r in dates]), F.col("k") + 1)
    frame = wide.orderBy("k", "ts_us").select("session_date", regime.alias("regime"), F.timestamp_micros("ts_us").alias("ts"), *columns)
    missing = absent.groupBy("session_date", "product").agg(F.sort_array(F.collect_list("message_type")).alias("absent"))  # types of a session
    named = plan.table(spark).select("s", "session_date", "product").join(stats, "s", "left").join(missing, ["session_date", "product"], "left")
    counters = [c for c in stats.columns if c not in ("s", "warning")]
    return frame, named.drop("s").fillna(0, counters)


def save_sessions(frame: DataFrame, path: str) -> None:
    """Write the frame by session in one job; sessions that are there already are replaced, others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date", "regime").parquet(path)


def session_book(spark: SparkSession, root: str, date: str, asset: Asset, depth: int = 10, window: Window = Window(), round_lot: float | None = None, odd_lots: bool = True, clock: str = "receipt", order_by: str = "sequence", fmt: str = "csv", on_missing: str = "fail") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(wide book on the grid, one row of replay statistics) of one asset and date."""
    frame, stats = extract_sessions(spark, root, [(date, "")], [asset], depth, window, False, clock, fmt, order_by, on_missing, None, round_lot, odd_lots)
    return frame.drop("session_date", "regime"), stats


def snapshot_pair(spark: SparkSession, paths: list[tuple[str, str, str, float]], levels: int, tz: str = "America/New_York") -> DataFrame:
    """Vendor snapshots (path, prefix, root, price scale) of several assets, outer-joined on time."""
    books = [src.snapshot(spark, p, prefix, root, levels, scale, tz) for p, prefix, root, scale in paths]
    return reduce(lambda x, y: x.join(y, "ts", "full_outer"), books).orderBy("ts")


def scale_warning(wide: DataFrame, a: str, b: str, most: float = 100.0) -> DataFrame:
    """median_a, median_b of the first bids, and whether b / a is above ``most``."""
    got = wide.agg(F.median(f"{a}_bidprice_1").alias("median_a"), F.median(f"{b}_bidprice_1").alias("median_b"))
    return got.withColumn("warning", F.coalesce(F.try_divide("median_b", "median_a") > most, F.lit(False)))


assert set(ORDER_TYPES + LEVEL_TYPES) <= set(MESSAGE_TYPES)
