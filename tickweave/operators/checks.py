"""Checks of a message log that need no replay, as findings, and the verdict.

``msgs`` has message_type, f, side, price, qty, ref, seq, ts_ns (nulls where absent).
A finding is (kind DATA or CODE, severity, check, subject, value, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators import sketches
from tickweave.operators.blocks import previous

FINDING = "struct<kind:string,severity:string,check:string,subject:string,value:double,message:string>"
#: Thresholds of the checks.
FEW_REMOVALS, BUSY_FEED, SIDE_OK, SIDE_FATAL, BAD_FIELD, PRICE_SPREAD, PRICED = 0.2, 1000, 0.99, 0.5, 0.01, 5.0, 100
GAP_SEVERE, GAP_FATAL, DEAD_ROWS, DEAD_SECONDS = 0.02, 0.2, 1000, 60
SEVERITIES = ["FATAL", "SEVERE", "MINOR"]


def finding(when: Column, kind: str, severity, check: str, subject, value, message: str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    fields = F.struct(F.lit(kind).alias("kind"), text(severity).alias("severity"), F.lit(check).alias("check"), text(subject).alias("subject"), value.cast("double").alias("value"), F.lit(message).alias("message"))
    return F.when(when, fields)


def findings(rows: DataFrame, *rules: Column) -> DataFrame:
    """The findings of all rules over all rows."""
    found = rows.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("x"))
    return found.select("x.*")


def _n(*types: str) -> Column:
    return F.count(F.when(F.col("message_type").isin(*types), 1))


ADDS, REMOVALS, LEVELS = ["mt_add_order"], ["mt_cancel_order", "mt_trade"], ["mt_price_level_update", "mt_modify_price_level", "mt_delete_price_level"]


def inventory(msgs: DataFrame) -> DataFrame:
    """message_type, n."""
    return msgs.groupBy("message_type").agg(F.count("*").alias("n"))


def check_inventory(msgs: DataFrame, failures: list[str] = ()) -> DataFrame:
    one = msgs.agg(_n(*ADDS).alias("adds"), _n("mt_cancel_order").alias("cancels"), _n(*REMOVALS).alias("removals"), _n(*LEVELS).alias("levels"))
    adds, cancels, removals, levels = (F.col(c) for c in ("adds", "cancels", "removals", "levels"))
    return findings(
        one,
        finding((adds > 0) & (removals == 0), "DATA", "FATAL", "inventory", "all", adds, "orders are added but never removed"),
        finding((adds > 0) & (removals > 0) & (cancels < FEW_REMOVALS * adds), "DATA", "SEVERE", "inventory", "all", cancels / adds, "few cancels for the adds"),
        finding((adds == 0) & (levels == 0), "DATA", "FATAL", "inventory", "all", adds, "neither orders nor price levels"),
        *[finding(F.lit(True), "DATA", "FATAL", "inventory", f, adds, "could not be read") for f in failures],
    )


CUBE = ["f", "message_type", "hour"]


def message_cube(msgs: DataFrame, hour: Column) -> DataFrame:
    """f, message_type, hour, level, n, with_price, volume: counts by all three, by feed and type, by feed, by type, and of all, in one shuffle.

    ``level`` names what a row is of; columns that it is not of are null.
    """
    sets = [CUBE, CUBE[:2], CUBE[:1], CUBE[1:2], []]
    fin = lambda c: F.when(~F.isnan(c), F.col(c))
    got = msgs.withColumn("hour", hour).groupingSets(sets, *CUBE).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"), F.count(fin("price")).alias("with_price"), F.sum(fin("qty")).alias("volume"))
    names = {0: "feed,type,hour", 1: "feed,type", 3: "feed", 5: "type", 7: "all"}
    level = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("_id").cast("int"))
    return got.select(*CUBE, level.alias("level"), "n", "with_price", "volume")


def feed_matrix(msgs: DataFrame) -> DataFrame:
    """f and a count for each message type."""
    return msgs.groupBy("f").agg(*[_n(t).alias(t) for t in [*ADDS, *REMOVALS, "mt_modify_order", *LEVELS]])


def check_feeds(msgs: DataFrame) -> DataFrame:
    adds, removals = F.col("mt_add_order"), F.col("mt_cancel_order") + F.col("mt_trade")
    return findings(
        feed_matrix(msgs),
        finding((adds > BUSY_FEED) & (removals == 0), "DATA", "FATAL", "feeds", F.col("f"), adds, "a feed adds orders but never removes any"),
        finding((adds > BUSY_FEED) & (removals > 0) & (removals < FEW_REMOVALS * adds), "DATA", "SEVERE", "feeds", F.col("f"), removals / adds, "a feed has few removals for its adds"),
    )


def field_health(msgs: DataFrame, exact: bool = True) -> DataFrame:
    """f, n, and shares: side_ok, bad_price, bad_qty, no_ref; median price. Not ``exact``: the median of a sketch (sketches.RANK_ERROR), a few KB a feed."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    p, q = F.col("price"), F.col("qty")
    bad = lambda c: c.isNull() | F.isnan(c)
    middle = F.median(F.when(~bad(p), p)) if exact else sketches.quantile(0.5, F.kll_sketch_agg_double(F.when(~bad(p), p), F.lit(sketches.K)))
    return msgs.groupBy("f").agg(
        F.count("*").alias("n"), share(F.trim("side").isin("Bid", "Ask")).alias("side_ok"), share(bad(p)).alias("bad_price"),
        share(bad(q) | (q < 0)).alias("bad_qty"), share(F.col("ref").isNull()).alias("no_ref"), middle.alias("median_price"),
    )


def side_tokens(msgs: DataFrame, k: int = 4) -> DataFrame:
    """f, side, n, rank: the most frequent side tokens of each feed."""
    counted = msgs.groupBy("f", F.coalesce(F.trim("side"), F.lit("<null>")).alias("side")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("f").orderBy(F.desc("n"), "side")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_fields(msgs: DataFrame, exact: bool = True) -> DataFrame:
    health = field_health(msgs, exact)
    c = F.col
    each = findings(
        health,
        finding(c("side_ok") < SIDE_OK, "DATA", F.when(c("side_ok") < SIDE_FATAL, "FATAL").otherwise("SEVERE"), "fields", c("f"), c("side_ok"), "side tokens are not recognised"),
        finding(c("bad_price") > BAD_FIELD, "DATA", "SEVERE", "fields", c("f"), c("bad_price"), "prices are missing"),
        finding(c("bad_qty") > BAD_FIELD, "DATA", "SEVERE", "fields", c("f"), c("bad_qty"), "quantities are missing or negative"),
        finding(c("no_ref") > BAD_FIELD, "DATA", "SEVERE", "fields", c("f"), c("no_ref"), "references are missing"),
    )
    spread = health.where(c("n") > PRICED).agg(F.try_divide(F.max("median_price"), F.min("median_price")).alias("spread"))
    return each.unionByName(findings(spread, finding(c("spread") > PRICE_SPREAD, "DATA", "SEVERE", "fields", "all", c("spread"), "feeds price on different scales")))


def sequence_continuity(msgs: DataFrame) -> DataFrame:
    """f, span, present, missing share of the sequence numbers."""
    got = msgs.where("seq is not null").groupBy("f").agg((F.max("seq") - F.min("seq") + 1).alias("span"), F.count_distinct("seq").alias("present"))
    return got.withColumn("missing", 1 - F.col("present") / F.col("span"))


def clock_inversions(msgs: DataFrame, block: int = 1_000_000) -> DataFrame:
    """f, pairs, inversions: neighbours in sequence (of one type) whose clocks go back. ``block``: sequence numbers windowed together."""
    rows = msgs.where("seq is not null").select("message_type", "f", "seq", "arrival", "ts_ns", F.floor(F.col("seq") / block).alias("_block"))
    step = previous(rows, "ts_ns", ["seq", "arrival"], "_block", "_was", ["message_type", "f"]).select("f", (F.col("ts_ns") - F.col("_was")).alias("d"))
    return step.groupBy("f").agg(F.count("d").alias("pairs"), F.count(F.when(F.col("d") < 0, 1)).alias("inversions"))


def check_sequence(msgs: DataFrame) -> DataFrame:
    c = F.col
    by_type = msgs.groupBy("message_type").agg(F.count("seq").alias("have"), F.count("*").alias("n"))
    total = by_type.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("have"), F.collect_list(F.when(c("have") == 0, c("message_type"))).alias("without"))  # one entry a type
    all_ = findings(
        total,
        finding(c("have") == 0, "CODE", "FATAL", "sequence", "sequencenumber", c("have"), "no row has a sequencenumber: venues' own order is lost"),
        finding((c("have") > 0) & (F.size("without") > 0), "CODE", "SEVERE", "sequence", F.array_join(F.sort_array("without"), ","), F.size("without"), "some message types lack sequencenumber"),
    )
    gaps = findings(
        sequence_continuity(msgs),
        finding(c("missing") > GAP_SEVERE, "DATA", F.when(c("missing") >= GAP_FATAL, "FATAL").otherwise("SEVERE"), "sequence", c("f"), c("missing"), "sequence numbers are missing"),
    )
    return all_.unionByName(gaps)


def clock_health(msgs: DataFrame, lo_ns: int, hi_ns: int) -> DataFrame:
    """f, n, null_clock, off_session, first_ns, last_ns."""
    t = F.col("ts_ns")
    return msgs.groupBy("f").agg(F.count("*").alias("n"), F.count(F.when(t.isNull(), 1)).alias("null_clock"), F.count(F.when((t < lo_ns) | (t > hi_ns), 1)).alias("off_session"), F.min(t).alias("first_ns"), F.max(t).alias("last_ns"))


def check_clock(msgs: DataFrame, lo_ns: int, hi_ns: int) -> DataFrame:
    c = F.col
    span = (c("last_ns") - c("first_ns")) / 1e9
    return findings(
        clock_health(msgs, lo_ns, hi_ns),
        finding(c("null_clock") > 0, "CODE", "FATAL", "clock", c("f"), c("null_clock"), "rows without a clock"),
        finding((c("n") > DEAD_ROWS) & (span < DEAD_SECONDS), "DATA", "FATAL", "clock", c("f"), span, "the clock stands still"),
    )


def frame_findings(msgs: DataFrame, lo_ns: int, hi_ns: int, failures: list[str] = (), exact: bool = True) -> DataFrame:
    return reduce(DataFrame.unionByName, [check_inventory(msgs, failures), check_feeds(msgs), check_fields(msgs, exact), check_sequence(msgs), check_clock(msgs, lo_ns, hi_ns)])


def verdict(found: DataFrame) -> DataFrame:
    """verdict (NONE, DATA, CODE, MIXED), rc, data, code (votes): MINOR does not vote."""
    votes = lambda k: F.count(F.when((F.col("kind") == k) & (F.col("severity") != "MINOR"), 1))
    one = found.agg(F.count("*").alias("n"), votes("DATA").alias("data"), votes("CODE").alias("code"))
    d, c = F.col("data"), F.col("code")
    lead = F.when(F.col("n") == 0, "NONE").when(d > c, "DATA").when(c > d, "CODE").otherwise("MIXED")
    return one.select(lead.alias("verdict"), F.when(F.col("n") == 0, 0).when(d > c, 2).otherwise(3).alias("rc"), "data", "code")


def _rank() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("kind"), F.col("check"), F.col("subject"), F.col("message")]


def ranked(found: DataFrame) -> DataFrame:
    """Findings by severity, then kind."""
    return found.orderBy(*_rank())


def placed(found: DataFrame) -> DataFrame:
    """Findings (a few rows) with their ``place`` in that order."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(*_rank())).cast("long"))
