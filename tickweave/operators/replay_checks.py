"""Checks that need the replay: orphans, resurrections, crossed books."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators import book, ladder
from tickweave.operators.checks import finding, findings
from tickweave.operators.ladder import EPS, standing
from tickweave.operators.ordering import ORDER, ordered_events
from tickweave.staging import staged

#: Thresholds of the checks.
EARLY_NS, EARLY_SHARE, ORPHAN_SEVERE, PRESENT_SEVERE, PRESENT_FATAL, GROWTH = 300 * 10**9, 0.8, 0.01, 0.05, 0.25, 5.0


def orphans(ordered: DataFrame, life: DataFrame | None = None) -> DataFrame:
    """Removals and trades without a resting order: f, code, ref, order, ts_ns, add_present, on_other_feed.

    Rows without a reference match nothing and are not joined.
    """
    life = book.lifecycle(ordered) if life is None else life
    missed = life.where("code in ('CANCEL', 'TRADE') and before <= 0")
    first = book.feeds_with_levels(ordered).select("f", "first_level")
    shown = F.coalesce((F.col("code") == "TRADE") & (F.struct(*ORDER) > F.col("first_level")), F.lit(False))
    lost = missed.join(first, "f", "left").where(~shown).select("f", "code", "ref", *ORDER, "ts_ns")
    adds = ordered.where("code = 'ADD' and ref is not null").groupBy("ref").agg(F.collect_set("f").alias("_feeds"))  # one entry a feed
    found = lost.where("ref is not null").join(adds, "ref", "left").unionByName(lost.where("ref is null").withColumn("_feeds", F.lit(None).cast("array<string>")))
    feeds = F.coalesce("_feeds", F.array().cast("array<string>"))
    here = F.array_contains(feeds, F.col("f"))
    return found.select("f", "code", "ref", *ORDER, "ts_ns", here.alias("add_present"), (F.size(feeds) > here.cast("int")).alias("on_other_feed"))


def orphan_summary(ordered: DataFrame, start_ns: int, life: DataFrame | None = None) -> DataFrame:
    """removals, present, absent, other_feed (of the absent), early (absent in the first five minutes)."""
    n = ordered.agg(F.count(F.when(F.col("code").isin("CANCEL", "TRADE"), 1)).alias("removals"))
    absent = ~F.col("add_present")
    got = orphans(ordered, life).agg(
        F.count(F.when(F.col("add_present"), 1)).alias("present"), F.count(F.when(absent, 1)).alias("absent"),
        F.count(F.when(absent & F.col("on_other_feed"), 1)).alias("other_feed"), F.count(F.when(absent & (F.col("ts_ns") <= start_ns + EARLY_NS), 1)).alias("early"),
    )
    return n.join(got)  # one row each


def check_orphans(summary: DataFrame) -> DataFrame:
    """Absent adds are rated by all removals, present ones by the removals that met no order."""
    c = F.col
    rate, present = F.try_divide(c("absent"), c("removals")), F.try_divide(c("present"), c("present") + c("absent"))
    early = c("early") > EARLY_SHARE * c("absent")
    return findings(
        summary,
        finding(c("other_feed") > 0, "DATA", "SEVERE", "orphans", "all", c("other_feed"), "removals name orders of another feed"),
        finding((c("absent") > 0) & ~early & (rate < ORPHAN_SEVERE), "DATA", "MINOR", "orphans", "all", rate, "a few removals without any add"),
        finding((c("absent") > 0) & ~early & (rate >= ORPHAN_SEVERE), "DATA", "SEVERE", "orphans", "all", rate, "removals without any add"),
        finding(present > PRESENT_SEVERE, "CODE", F.when(present > PRESENT_FATAL, "FATAL").otherwise("SEVERE"), "orphans", "all", present, "removals of orders whose add is in the log: the order of events is wrong"),
    )


def orphans_by_feed(found: DataFrame, feeds: int = 6) -> DataFrame:
    """f, n: the feeds with most orphans."""
    return found.groupBy("f").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").limit(feeds)


def resurrections(ordered: DataFrame, life: DataFrame | None = None) -> DataFrame:
    """Modifies of an order that is gone because a cancel or trade had taken it: f, ref, order."""
    life = book.lifecycle(ordered) if life is None else life
    old = ((F.col("op") == "DEL") & (F.col("sub") == 0) | F.col("same")) & (F.col("before") <= 0) & (F.col("killed_before") > 0)
    return life.where("code = 'MODIFY'").where(old & ~F.col("keyless")).select("f", F.col("key").alias("ref"), *ORDER)


def resting_again(ordered: DataFrame, life: DataFrame) -> DataFrame:
    """f, ref of orders that such a modify brought back and that rest at the end."""
    back = resurrections(ordered, life).drop("ref").join(ordered.where("code = 'MODIFY'").select("f", *ORDER, "ref"), ["f", *ORDER])
    return book.resting(ordered, life).join(back.select("f", "ref").distinct(), ["f", "ref"], "left_semi").select("f", "ref")


def check_resurrections(found: DataFrame) -> DataFrame:
    n = found.agg(F.count("*").alias("n"))
    return findings(n, finding(F.col("n") > 0, "CODE", "FATAL", "resurrections", "all", F.col("n"), "orders come back after their removal: events are replayed out of order"))


def resting_series(ordered: DataFrame, g0_ns: int, step_ns: int, points: int, life: DataFrame | None = None) -> DataFrame:
    """gi, resting: orders that rest at each grid point."""
    life = book.lifecycle(ordered) if life is None else life
    step = F.when((F.col("before") <= 0) & (F.col("after") > 0) & ~F.col("keyless"), 1).when((F.col("before") > 0) & (F.col("after") <= 0), -1).otherwise(0)
    moved = life.withColumn("gi", ladder.grid_index("eff_ts", g0_ns, step_ns)).where(F.col("gi") < points).groupBy("gi").agg(F.sum(step).alias("d"))
    grid = ladder.grid(ordered.sparkSession, points).join(moved, "gi", "left").fillna(0, ["d"])
    return grid.select("gi", F.sum("d").over(Window.orderBy("gi")).alias("resting"))  # grid points only


def dynamics(resting: DataFrame, top: DataFrame, points: int) -> DataFrame:
    """growth (1 on a grid of ten points or fewer), first_mean, greatest, early_crossed: the opening is the first 60 points, or a hundredth of all if that is more."""
    first = max(60, points // 100)
    both = resting.join(top.select("gi", "crossed"), "gi", "left").fillna(0, ["crossed"])
    opening = lambda c: F.avg(F.when(F.col("gi") < first, F.col(c).cast("double")))
    one = both.agg(opening("resting").alias("first_mean"), F.max("resting").alias("greatest"), opening("crossed").alias("early_crossed"))
    return one.withColumn("growth", (F.col("greatest") + 1) / (F.col("first_mean") + 1) if points > 10 else F.lit(1.0))


def sextiles(series: DataFrame, value: str, points: int) -> DataFrame:
    """sextile (0-5), mean: cut at i * n // 6."""
    cuts = [i * points // 6 for i in range(7)]
    at = F.lit(5)
    for k in range(4, -1, -1):
        at = F.when(F.col("gi") < cuts[k + 1], k).otherwise(at)
    return series.groupBy(at.alias("sextile")).agg(F.avg(F.col(value).cast("double")).alias("mean"))


def feed_crossings(spans: DataFrame) -> DataFrame:
    """gi, f, bid1, ask1 where one venue's own book is crossed."""
    best = standing(spans, 1, ["f"])
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("price")))
    return best.groupBy("gi", "f").agg(one("Bid").alias("bid1"), one("Ask").alias("ask1")).where(F.col("bid1") > F.col("ask1") + EPS)


def pins(crossings: DataFrame) -> DataFrame:
    """f, side, price, snapshots: how often a price was the top of a crossed venue."""
    sides = F.explode(F.array(F.struct(F.lit("Bid").alias("side"), F.col("bid1").alias("price")), F.struct(F.lit("Ask").alias("side"), F.col("ask1").alias("price")))).alias("x")
    return crossings.select("f", sides).groupBy("f", "x.side", "x.price").agg(F.count("*").alias("snapshots"))


def wrong_side(ordered: DataFrame, life: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Orders resting at the end beyond their own venue's opposite top, where that venue's book is crossed."""
    held = book.resting(ordered, life)
    changes = book.levels(ordered, life) if changes is None else changes
    last = changes.groupBy("f", "side", "price").agg(F.max(F.struct(*ORDER, "sub", "level"))["level"].alias("level")).where(F.col("level") > EPS)
    tops = last.groupBy("f").agg(F.max(F.when(F.col("side") == "Bid", F.col("price"))).alias("bid1"), F.min(F.when(F.col("side") == "Ask", F.col("price"))).alias("ask1"))
    crossed = tops.where(F.col("bid1") > F.col("ask1") + EPS)
    bad = ((F.col("side") == "Bid") & (F.col("price") > F.col("ask1") + EPS)) | ((F.col("side") == "Ask") & (F.col("price") < F.col("bid1") - EPS))
    return held.join(crossed, "f").where(bad).select("f", "ref", "side", "price", "size", "born")


def oldest_wrong(found: DataFrame, feeds: int = 6, orders: int = 3) -> DataFrame:
    """The oldest wrong-side orders of the feeds that have most."""
    n = found.groupBy("f").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "f").limit(feeds)
    w = Window.partitionBy("f").orderBy(F.asc_nulls_last("born"), "ref")
    return found.join(top, "f").withColumn("k", F.row_number().over(w)).where(F.col("k") <= orders).select("f", "n", "ref", "side", "price", "born", "k")


def check_dynamics(dyn: DataFrame, consolidated: DataFrame, any_feed_rate: DataFrame, wrong: DataFrame, revived: DataFrame) -> DataFrame:
    c = F.col
    one = dyn.join(consolidated.select("rate")).join(any_feed_rate.select(c("rate").alias("feed_rate"))).join(wrong.agg(F.count("*").alias("wrong"))).join(revived.agg(F.count("*").alias("revived")))
    return findings(
        one,
        finding(c("growth") > GROWTH, "DATA", "SEVERE", "dynamics", "all", c("growth"), "resting orders grow: removals are missing"),
        finding((c("early_crossed") > 0.5) & (c("growth") < 2), "CODE", "SEVERE", "dynamics", "all", c("early_crossed"), "crossed from the start while the book does not grow"),
        finding((c("rate") > 0.01) & (c("feed_rate") < 0.1 * c("rate")), "DATA", "SEVERE", "venues", "all", c("rate"), "the consolidated book is crossed, no venue's own is"),
        finding((c("rate") > 0.01) & (c("feed_rate") > 0.5 * c("rate")) & (c("growth") <= 2), "CODE", "SEVERE", "venues", "all", c("feed_rate"), "venues' own books are crossed"),
        finding((c("wrong") > 0) & (c("growth") < 2) & (c("revived") == 0), "CODE", "SEVERE", "wrong_side", "all", c("wrong"), "orders rest on the wrong side at the close"),
    )


def spans_of(events: DataFrame, g0_ns: int, step_ns: int, points: int, order_by: str = "sequence") -> DataFrame:
    return ladder.intervals(book.levels(ordered_events(events, order_by)), g0_ns, step_ns, points)


@dataclass
class Replay:
    """What the checks of one replay share, each written once: ordered events, steps of orders, level changes, stretches of levels."""

    ordered: DataFrame
    life: DataFrame
    changes: DataFrame
    spans: DataFrame
    g0_ns: int
    step_ns: int
    points: int

    @classmethod
    def of(cls, events: DataFrame, g0_ns: int, step_ns: int, points: int, order_by: str = "sequence") -> Replay:
        ordered = staged(ordered_events(events, order_by), "ordered")
        life = staged(book.lifecycle(ordered), "lifecycle")
        changes = staged(book.levels(ordered, life), "levels")
        return cls(ordered, life, changes, staged(ladder.intervals(changes, g0_ns, step_ns, points), "spans"), g0_ns, step_ns, points)

    def top(self) -> DataFrame:
        return ladder.top_of_book(ladder.ladder(self.spans, 1))

    def orphans(self) -> DataFrame:
        return orphans(self.ordered, self.life)

    def resurrections(self) -> DataFrame:
        return resurrections(self.ordered, self.life)

    def wrong_side(self) -> DataFrame:
        return wrong_side(self.ordered, self.life, self.changes)

    def crossings(self) -> DataFrame:
        return feed_crossings(self.spans)

    def resting(self) -> DataFrame:
        return resting_series(self.ordered, self.g0_ns, self.step_ns, self.points, self.life)

    def details(self) -> list[tuple[str, DataFrame]]:
        """(title, a few rows) of what the report shows beside the findings."""
        series = {"resting orders": (self.resting(), "resting"), "crossed": (ladder.grid(self.ordered.sparkSession, self.points).join(self.top(), "gi", "left").fillna(0, ["crossed"]), "crossed")}
        by_feed = lambda df: df.groupBy("f").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").limit(6)
        rates = self.top().agg((F.coalesce(F.sum("crossed"), F.lit(0)) / self.points).alias("consolidated")).join(self.crossings().agg((F.count_distinct("gi") / self.points).alias("any_venue")))
        again = resting_again(self.ordered, self.life).agg(F.count("*").alias("still_resting"))
        return [
            ("orphans", orphan_summary(self.ordered, self.g0_ns, self.life)),
            ("orphans by feed", orphans_by_feed(self.orphans())),
            *((f"{name} by sixth of the session", sextiles(df, value, self.points).orderBy("sextile")) for name, (df, value) in series.items()),
            ("crossed share", rates),
            ("replay", book.replay_stats(self.ordered, self.life)),
            ("revived orders by feed", by_feed(self.resurrections())),
            ("revived orders", again),
            ("wrong side, oldest", oldest_wrong(self.wrong_side()).orderBy(F.desc("n"), "f", "k")),
            ("pinned prices", pins(self.crossings()).orderBy(F.desc("snapshots"), "f", "side", "price").limit(6)),
        ]

    def findings(self) -> DataFrame:
        top = staged(self.top(), "top")
        crossed = F.coalesce(F.sum("crossed"), F.lit(0)) / self.points
        any_feed = self.crossings().agg((F.count_distinct("gi") / self.points).alias("rate"))
        dyn = dynamics(self.resting(), top, self.points)
        revived = self.resurrections()
        parts = [
            check_orphans(orphan_summary(self.ordered, self.g0_ns, self.life)),
            check_resurrections(revived),
            check_dynamics(dyn, top.agg(crossed.alias("rate")), any_feed, self.wrong_side(), revived),
        ]
        return reduce(DataFrame.unionByName, parts)


def replay_findings(events: DataFrame, g0_ns: int, step_ns: int, points: int, order_by: str = "sequence") -> DataFrame:
    return Replay.of(events, g0_ns, step_ns, points, order_by).findings()


def ordering_ab(events: DataFrame, g0_ns: int, step_ns: int, points: int) -> DataFrame:
    """rate by clock and by sequence; a finding's worth: clock order crossed, sequence order far less."""
    a = ladder.crossed_rate(spans_of(events, g0_ns, step_ns, points, "clock"), points).select(F.col("rate").alias("clock_rate"))
    b = ladder.crossed_rate(spans_of(events, g0_ns, step_ns, points), points).select(F.col("rate").alias("sequence_rate"))
    return a.join(b)


def check_ordering(rates: DataFrame, current: str = "clock_rate", other: str = "sequence_rate") -> DataFrame:
    cur, alt = F.col(current), F.col(other)
    return findings(rates, finding((cur > 0.05) & (alt < 0.5 * cur), "CODE", F.when(alt < 0.01, "FATAL").otherwise("SEVERE"), "ordering", "all", cur, "another event order removes the crossing"))
