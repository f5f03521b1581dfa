"""Order-book replay by windows.

Orders: each (feed, ref) is a sequence of SET (add, modified to), DEL (cancel,
modified from) and RED (trade). A running count of SET and DEL cuts it into
generations; within one, what remains is the size less the reductions so far.

Levels: each (feed, side, price) gets the differences of its orders, and assigned
sizes of price-level feeds; a running sum within the stretch since the last
assignment is the level. Prices hit by a trade without an order are running sums
with a bound at 0, composed over blocks of the order.

A modify with an invalid new price or size and another reference takes its own
reference away only if the old one is not resting (step IFGONE). Which of those
steps take effect is found among them alone (fired); all else stays with the windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tickweave.operators.blocks import bounded_sum, tasks_for
from tickweave.operators.ordering import ORDER, block_of
from tickweave.staging import staged

EPS = 1e-9
SIDES = ["Bid", "Ask"]


def valid() -> Column:
    """Whether a row can rest: finite price and size, size over 0, a side."""
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return fin("price") & fin("qty") & (F.col("qty") > 0) & F.col("side").isin(SIDES)


def order_steps(ordered: DataFrame) -> DataFrame:
    """Events as steps of order keys: op SET, DEL, IFGONE or RED of (f, ref), sub 0 before 1 within an event."""
    ev = ordered.where(F.col("code").isin("ADD", "CANCEL", "MODIFY", "TRADE")).withColumn("_ok", F.coalesce(valid(), F.lit(False)))
    step = lambda op, ref, sub: F.struct(F.lit(op).alias("op"), F.col(ref).alias("key"), F.lit(sub).alias("sub"))
    none = F.array().cast("array<struct<op:string,key:string,sub:int>>")
    same = F.col("prev_ref").eqNullSafe(F.col("ref"))
    steps = (
        F.when(F.col("code") == "ADD", F.when(F.col("_ok"), F.array(step("SET", "ref", 1))).otherwise(none))
        .when(F.col("code") == "CANCEL", F.array(step("DEL", "ref", 0)))
        .when(F.col("code") == "TRADE", F.array(step("RED", "ref", 0)))
        .when(same, F.when(F.col("_ok"), F.array(step("SET", "ref", 1))).otherwise(F.array(step("DEL", "ref", 0))))
        .otherwise(F.when(F.col("_ok"), F.array(step("DEL", "prev_ref", 0), step("SET", "ref", 1))).otherwise(F.array(step("DEL", "prev_ref", 0), step("IFGONE", "ref", 1))))
    )
    # A missing reference never matches: each such step is a key of its own, so they do not meet in one task.
    key = F.coalesce("_s.key", F.concat(F.lit("\0"), F.col("arrival").cast("string")))
    return ev.withColumn("_s", F.explode(steps)).select("f", "code", "side", "price", "qty", "ref", "maintain", "ts_ns", "eff_ts", *ORDER, "_s.op", key.alias("key"), F.col("_s.key").isNull().alias("keyless"), "_s.sub", same.alias("same"))


def fired(steps: DataFrame, odd: DataFrame) -> DataFrame:
    """f and order of the odd modifies (see above) whose own reference is taken away.

    Such a modify takes effect if its previous reference is not resting: because no order
    rests there (what the windows say, without any of these steps), or because an earlier one of
    them took it away in the same generation. So each has a pointer to the last of those;
    effects are handed along the pointers until no more come. Only the odd modifies
    themselves take part, and a round is needed for each hop from reference to reference.
    """
    touched = odd.select("f", F.explode(F.array("prev_ref", "ref")).alias("key")).where("key is not null").distinct()
    near = generations(steps.join(touched, ["f", "key"], "left_semi"))
    w = Window.partitionBy("f", "key").orderBy(*ORDER, "sub")
    is_if = F.col("op") == "IFGONE"
    last = F.last(F.when(is_if, F.struct("gen", *ORDER)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumns({"_was": F.coalesce(F.lag("after").over(w), F.lit(0.0)), "_gen": F.lag("gen").over(w), "_if": last})
    event = ["f", *ORDER]
    asked = near.where("op = 'DEL' and code = 'MODIFY'").select(*event, (F.col("_was") > 0).alias("rests"), F.when(F.col("_if.gen") == F.col("_gen"), F.struct("f", *[F.col(f"_if.{c}").alias(c) for c in ORDER])).alias("parent"))
    told = near.where(is_if).select(*event, "key", "gen")
    nodes = staged(told.join(asked, event, "left").select(*event, "key", "gen", "parent", (~F.coalesce("rests", F.lit(False))).alias("gone")), "odd")
    n = -1
    while (found := nodes.where("gone").count()) > n:
        n = found
        upto = Window.partitionBy("f", "key", "gen").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        sofar = nodes.withColumn("any", F.max("gone").over(upto)).where("any").select(F.struct(*event).alias("parent"), F.lit(True).alias("_earlier"))
        nodes = staged(nodes.join(sofar, "parent", "left").select(*event, "key", "gen", "parent", (F.col("gone") | F.coalesce("_earlier", F.lit(False))).alias("gone")), "odd")
    return nodes.where("gone").select(*event)


def resolved(ordered: DataFrame) -> DataFrame:
    """order_steps() with IFGONE decided: DEL if it takes effect, else left out. One short job asks whether there is any."""
    steps = order_steps(ordered)
    odd = ordered.where(_odd())
    if odd.isEmpty():
        return steps
    at = steps.join(fired(steps, odd).withColumn("_fired", F.lit(True)), ["f", *ORDER], "left").where("op <> 'IFGONE' or (_fired and not keyless)")
    return at.withColumn("op", F.when(F.col("op") == "IFGONE", "DEL").otherwise(F.col("op"))).select(steps.columns)


def generations(steps: DataFrame) -> DataFrame:
    """steps with ``gen`` (SET and DEL of the key so far) and what it rests as after the step: ``after`` (size), ``_side``, ``_price``."""
    w = Window.partitionBy("f", "key").orderBy(*ORDER, "sub")
    gen = Window.partitionBy("f", "key", "gen").orderBy(*ORDER, "sub").rowsBetween(Window.unboundedPreceding, 0)
    cut = steps.withColumn("gen", F.sum(F.when(F.col("op").isin("SET", "DEL"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    is_set = F.col("op") == "SET"
    fin = F.when(F.col("qty").isNotNull() & ~F.isnan("qty"), F.col("qty")).otherwise(0.0)
    cut = cut.withColumns(
        {
            "_size": F.first(F.when(is_set, F.col("qty")).otherwise(0.0)).over(gen),
            "_side": F.first(F.when(is_set, F.col("side"))).over(gen),
            "_price": F.first(F.when(is_set, F.col("price"))).over(gen),
            "_taken": F.sum(F.when(F.col("op") == "RED", fin).otherwise(0.0)).over(gen),
        }
    )
    left = F.when(F.col("gen") == 0, 0.0).otherwise(F.col("_size") - F.col("_taken"))
    return cut.withColumn("after", F.when(left > EPS, left).otherwise(0.0)).drop("_size", "_taken")


def lifecycle(ordered: DataFrame) -> DataFrame:
    """Steps with ``before`` (size of the order just before: 0 if it was not resting), ``after``, the side and price it rested at.

    ``killed_before``: a cancel or trade took the order away, and nothing has set its reference since.
    """
    # Dealt out by the number of events: else a task's share, sorted in memory, would be what few partitions make it.
    cut = generations(resolved(ordered).repartition(tasks_for(ordered), "f", "key"))
    w = Window.partitionBy("f", "key").orderBy("gen", *ORDER, "sub")  # gen never falls: the order that the rows have by now
    is_set = F.col("op") == "SET"
    lagged = lambda c: F.lag(c).over(w)
    cut = cut.withColumns({"before": F.when(F.col("keyless"), 0.0).otherwise(F.coalesce(lagged("after"), F.lit(0.0))), "was_side": lagged("_side"), "was_price": lagged("_price")})
    kill = F.col("code").isin("CANCEL", "TRADE") & (F.col("before") > 0) & (F.col("after") <= 0)
    state = F.last(F.when(is_set, 0).when(kill, 1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("killed_before", F.coalesce(state, F.lit(0)))


def level_deltas(life: DataFrame) -> DataFrame:
    """Differences of levels: f, side, price, order, delta; ``clamp``: a removal or add, after which a level of EPS or less is gone."""
    gone = F.when(F.col("op") == "RED", F.when(F.col("after") > 0, F.col("after") - F.col("before")).otherwise(-F.col("before"))).otherwise(-F.col("before"))

    def one(sub: Column, side: str, price: str, delta: Column, whole: Column) -> Column:
        return F.struct(sub.alias("sub"), F.col(side).alias("side"), F.col(price).alias("price"), delta.alias("delta"), whole.alias("whole"))

    left = F.when(F.col("before") > 0, one(F.col("sub") * 2, "was_side", "was_price", gone, (F.col("op") != "RED") | (F.col("after") <= 0)))
    new = F.when((F.col("op") == "SET") & ~F.col("keyless"), one(F.col("sub") * 2 + 1, "side", "price", F.col("qty"), F.lit(True)))
    # One pass: a step takes from where the order rested and gives to where it goes.
    return life.select("f", *ORDER, "eff_ts", F.explode(F.array_compact(F.array(left, new))).alias("d")).select("f", *ORDER, "eff_ts", "d.*")


def refless_trades(life: DataFrame, level_feeds: DataFrame) -> DataFrame:
    """Unmatched trades with ``on_level``: their feed had shown price levels before (then they are skipped)."""
    lost = life.where("code = 'TRADE' and before <= 0")
    first = level_feeds.select("f", "first_level")
    return lost.join(first, "f", "left").withColumn("on_level", F.coalesce(F.struct(*ORDER) > F.col("first_level"), F.lit(False)))


def feeds_with_levels(ordered: DataFrame) -> DataFrame:
    """Feeds that show price levels, with the order of their first one."""
    return ordered.where(F.col("code").isin("LEVEL_SET", "LEVEL_DEL")).groupBy("f").agg(F.min(F.struct(*ORDER)).alias("first_level"))


def _hit(moves: DataFrame, side: str) -> DataFrame:
    """One side of prices that are hit by trades without an order: moves and takes, with ``level`` and ``had`` (whether the side showed one just before)."""
    take, assign = F.col("kind") == "take", F.col("kind") == "assign"
    # A removal or add that empties a level ends it; so does a take. A part that is traded does not.
    ends = take | ((F.col("delta") < 0) & F.col("whole"))
    floor = F.when(assign, F.when(F.col("delta") > EPS, F.col("delta")).otherwise(0.0)).when(ends, 0.0)
    order = [*ORDER, "sub"]
    own = moves.where(take | (F.col("side") == side)).withColumn("_block", block_of())
    # At most EPS is nothing, but after a part was traded from a level that a take had made too small.
    part = ~ends & ~assign
    got = bounded_sum(own, F.when(take, -F.col("delta")).otherwise(F.col("delta")), floor, assign, part, order, "_block", ["f", "price"], "level")
    had = (F.col("level_before") > EPS) | F.coalesce("carry_before", F.lit(False))
    level = F.when((F.col("level") > EPS) | part, F.col("level")).otherwise(0.0)
    return got.withColumns({"side": F.lit(side), "had": had, "level": level}).drop("_block", "level_before", "carry_before")


def hit_levels(moves: DataFrame) -> DataFrame:
    """Levels of the prices that trades without an order hit: such a trade takes from the ask if there is one, else from the bid, else from nothing."""
    asks = staged(_hit(moves, "Ask"), "asks")
    left = asks.where("kind = 'take' and not had").select(moves.columns)
    bids = _hit(moves.where("kind <> 'take' and side = 'Bid'").unionByName(left), "Bid")
    return asks.unionByName(bids).where("kind <> 'take' or had")


def levels(ordered: DataFrame, life: DataFrame | None = None) -> DataFrame:
    """Every change of a level: f, side, price, order, sub, eff_ts, level (0 or less: gone).

    Running sums give all levels but those that can be cut short: a price hit by a trade
    without an order, or with both orders and assigned sizes (a removal may be more than
    what is shown). Those are sums with a bound (blocks.bounded_sum). One short
    job asks which feeds can have any.
    ``life``: lifecycle(ordered), if it is at hand.
    """
    life = lifecycle(ordered) if life is None else life
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    kinds = ordered.groupBy("f").agg(any_(F.col("code").isin("LEVEL_SET", "LEVEL_DEL")).alias("shown"), any_(F.col("code").isin("ADD", "MODIFY")).alias("orders"), any_((F.col("code") == "TRADE") & F.col("price").isNotNull()).alias("priced"))
    priced, dual = kinds.agg(F.coalesce(F.max("priced"), F.lit(False)), F.coalesce(F.max(F.col("shown") & F.col("orders")), F.lit(False))).first()
    cols = ["f", "side", "price", *ORDER, "sub", "eff_ts", "level"]
    base = ["f", "side", "price", *ORDER, "sub", "eff_ts", "delta", "whole", "kind"]
    deltas = level_deltas(life).withColumn("kind", F.lit("delta"))
    fin = F.when(F.col("qty").isNotNull() & ~F.isnan("qty") & (F.col("code") == "LEVEL_SET"), F.col("qty")).otherwise(0.0)
    assigned = ordered.where(F.col("code").isin("LEVEL_SET", "LEVEL_DEL") & F.col("side").isin(SIDES) & F.col("price").isNotNull()).withColumns({"sub": F.lit(0), "delta": fin, "whole": F.lit(True), "kind": F.lit("assign")})
    moves = reduce(DataFrame.unionByName, [x.select(*base) for x in (deltas, assigned)])
    n_tasks = tasks_for(ordered)
    if not priced and not dual:
        return _summed(moves, n_tasks).select(*cols)
    lost = refless_trades(life, feeds_with_levels(ordered)).where(~F.col("on_level") & F.col("price").isNotNull())
    takes = lost.select("f", "side", "price", *ORDER, F.lit(0).alias("sub"), "eff_ts", F.coalesce("qty", F.lit(0.0)).alias("delta"), F.lit(True).alias("whole"), F.lit("take").alias("kind"))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    every = staged(moves.unionByName(takes), "moves")
    moves = every.where("kind <> 'take'")
    hit = every.groupBy("f", "price").agg(n("take").alias("t"), n("assign").alias("a"), n("delta").alias("d")).where("t > 0 or (a > 0 and d > 0)").select("f", "price")
    return _summed(moves.join(hit, ["f", "price"], "left_anti"), n_tasks).select(*cols).unionByName(hit_levels(every.join(hit, ["f", "price"], "left_semi")).select(*cols))


def _summed(moves: DataFrame, tasks: int) -> DataFrame:
    """Levels as running sums since the last assignment."""
    # Dealt out by a hash of side and price: windows compare doubles in a normal form, which a price as it is does not share.
    moves = moves.withColumn("_at", F.xxhash64("side", F.col("price") + 0.0)).repartition(tasks, "f", "_at")
    w = Window.partitionBy("f", "_at", "side", "price").orderBy(*ORDER, "sub").rowsBetween(Window.unboundedPreceding, 0)
    stretch = Window.partitionBy("f", "_at", "side", "price", "_set").orderBy(*ORDER, "sub").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("_set", F.sum(F.when(F.col("kind") == "assign", 1).otherwise(0)).over(w)).withColumn("level", F.sum("delta").over(stretch))


def _odd() -> Column:
    return (F.col("code") == "MODIFY") & ~F.coalesce(valid(), F.lit(False)) & ~F.col("prev_ref").eqNullSafe(F.col("ref"))


def resting(ordered: DataFrame, life: DataFrame | None = None) -> DataFrame:
    """Orders that rest at the end: f, ref, side, price, size, born (clock of the SET)."""
    life = lifecycle(ordered) if life is None else life
    last = life.groupBy("f", "key").agg(F.max(F.struct(*ORDER, "sub", "after", "_side", "_price", "keyless")).alias("x"), F.max(F.when(F.col("op") == "SET", F.struct(*ORDER, "ts_ns")))["ts_ns"].alias("born"))
    return last.where("x.after > 0 and not x.keyless").select("f", F.col("key").alias("ref"), F.col("x._side").alias("side"), F.col("x._price").alias("price"), F.col("x.after").alias("size"), "born")


def dual_feeds(ordered: DataFrame) -> DataFrame:
    """f of feeds that show both orders and price levels."""
    orders = ordered.where(F.col("code").isin("ADD", "MODIFY") & F.coalesce(valid(), F.lit(False))).select("f")
    return orders.intersect(feeds_with_levels(ordered).select("f"))


def counted(events: DataFrame) -> tuple[DataFrame, Observation]:
    """(the events, counters of what the replay leaves out or cannot place): counted as they pass by, there after an action.

    rows, no_clock, no_feed, no_seq, no_ref (of order events), rejected_adds (no finite price and size above 0, or no side).
    """
    counters = Observation()
    n = lambda c: F.count(F.when(c, 1))
    orders = F.col("code").isin("ADD", "CANCEL", "MODIFY", "TRADE")
    return events.observe(
        counters, F.count("*").alias("rows"), n(F.col("ts_ns").isNull()).alias("no_clock"), n(F.col("f").isNull()).alias("no_feed"), n(F.col("seq").isNull()).alias("no_seq"),
        n(orders & F.col("ref").isNull()).alias("no_ref"), n((F.col("code") == "ADD") & ~F.coalesce(valid(), F.lit(False))).alias("rejected_adds"),
    ), counters


def replay_stats(ordered: DataFrame, life: DataFrame | None = None, by: Column | None = None) -> DataFrame:
    """One row of counters, as longs: one pass over the events, one shuffle of their steps by event. ``by``: a function of f, a row (and column) of each of its values."""
    keys = [] if by is None else [by]
    n = lambda code: F.count(F.when(F.col("code") == code, 1))
    events = ordered.groupBy(*keys).agg(F.count("*").alias("events"), *[n(c).alias(f"n_{c.lower()}") for c in ("ADD", "CANCEL", "MODIFY", "TRADE", "LEVEL_SET", "LEVEL_DEL")], F.count(F.when((F.col("code") == "MODIFY") & ~F.col("maintain"), 1)).alias("modify_reprioritized"), F.count(F.when(F.col("code").isin("LEVEL_SET", "LEVEL_DEL"), 1)).alias("mbp_level_events"))
    met = F.col("before") > 0
    life = lifecycle(ordered) if life is None else life
    first = F.broadcast(feeds_with_levels(ordered).select("f", "first_level"))  # a row a feed
    is_set, code = F.col("op") == "SET", F.col("code")
    # All counters but one are of single steps. That one is of modifies which take one order away and set another, both resting.
    lost = (code == "TRADE") & ~met
    shown = F.coalesce(F.struct(*ORDER) > F.col("first_level"), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    single = life.join(first, "f", "left").groupBy(*keys).agg(
        count(is_set & (code == "ADD") & met).alias("dup_add"), count((code == "CANCEL") & ~met).alias("cancel_no_order"),
        count(lost & shown).alias("trade_on_mbp_skipped"), count(lost & ~shown).alias("trade_no_ref"),
    )
    moved = life.where((code == "MODIFY") & met).groupBy("f", *ORDER).agg(F.max(is_set).alias("onto"), F.max(~is_set).alias("took")).where("onto and took")
    names = single.columns
    zeros = [F.lit(0).cast("long").alias(c) for c in names[-3:]]
    both = single.unionByName(moved.groupBy(*keys).agg(F.count("*").alias("dup_add")).select("*", *zeros))
    counted = both.groupBy(*names[:-4]).agg(*[F.sum(c).alias(c) for c in names[-4:]])
    if by is None:
        return events.join(counted)  # one row each
    counters = [c for c in counted.columns if c not in events.columns]
    return events.join(counted, [c for c in counted.columns if c in events.columns], "left").fillna(0, counters)
