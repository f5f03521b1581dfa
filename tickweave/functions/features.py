"""Liquidity features of a book: level-1 measures and the cost of a lot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """Each price weighted by the other side's quantity: a heavy bid pulls it up."""
    return F.when(bid_qty + ask_qty > EPS, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty))


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when(mid(bid, ask) > EPS, (ask - bid) / mid(bid, ask) * 1e4)


def usable(price: Column, qty: Column) -> Column:
    """The quantity of a whole level, 0 of a torn one."""
    return F.when(price.isNotNull() & qty.isNotNull() & ~F.isnan(price) & ~F.isnan(qty), qty).otherwise(0.0)


def vwap_to_lot(ladder: DataFrame, keys: list[str], lot: float, level: str = "level", price: str = "price", qty: str = "qty") -> DataFrame:
    """keys, vwap (null unless the lot is filled), filled, levels_used of each ladder in long form."""
    q = usable(F.col(price), F.col(qty))
    before = F.coalesce(F.sum("_q").over(Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    fills = ladder.withColumn("_q", q).withColumn("_fill", F.greatest(F.lit(0.0), F.least(F.col("_q"), F.lit(lot) - before)))
    cost = F.sum(F.when(F.col("_fill") > 0, F.col(price) * F.col("_fill")))
    filled = F.sum("_fill")
    return fills.groupBy(*keys).agg(F.when(filled >= lot - EPS, cost / lot).alias("vwap"), filled.alias("filled"), F.count(F.when(F.col("_fill") > 0, 1)).alias("levels_used"))


def with_features(wide: DataFrame, root: str) -> DataFrame:
    """The canonical book with {root}_mid, _wmid and _spread_bps of its first level."""
    b, bq, a, aq = (F.col(f"{root}_{x}_1") for x in ("bidprice", "bidquantity", "askprice", "askquantity"))
    return wide.withColumns({f"{root}_mid": mid(b, a), f"{root}_wmid": microprice(b, bq, a, aq), f"{root}_spread_bps": spread_bps(b, a)})


def depth_weighted_mid(levels: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Own definition (non_reference): mid of the quantity-weighted mean prices of both sides; null if one is empty."""
    side = lambda p, q: F.try_divide(sum((F.coalesce(x[p] * x[q], F.lit(0.0)) for x in levels), F.lit(0.0)), sum((F.when(x[p].isNotNull(), x[q]).otherwise(0.0) for x in levels), F.lit(0.0)))
    return (side(0, 1) + side(2, 3)) / 2


def side_costs(ladder: DataFrame, keys: list[str], decay: float = 3.0, level: str = "level", price: str = "price", qty: str = "qty") -> DataFrame:
    """Own definitions (non_reference) of one side's shape: keys, decay_cost_bps, impact_length.

    decay_cost_bps: mean distance from the first level's price in basis points,
    levels weighted by quantity and exp(-(level - 1) / decay). impact_length: length of
    the curve of price distance over cumulated quantity, both scaled to 1: it is
    in [sqrt 2, 2], null for fewer than two whole levels.
    """
    w = Window.partitionBy(*keys).orderBy(level)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = ladder.withColumn("_q", usable(F.col(price), F.col(qty))).where(F.col("_q") > 0)
    far = F.abs(F.col(price) - F.first(price).over(upto))
    steps = whole.withColumns({"_far": far, "_cum": F.sum("_q").over(upto), "_weight": F.col("_q") * F.exp(-(F.col(level) - 1) / decay)})
    every = Window.partitionBy(*keys)
    first_q = F.first("_q").over(upto)
    scaled = steps.withColumns({"_x": F.try_divide(F.col("_cum") - first_q, F.sum("_q").over(every) - first_q), "_y": F.try_divide(F.col("_far"), F.max("_far").over(every)), "_bps": F.try_divide(F.col("_far"), F.first(price).over(upto)) * 1e4})
    moved = scaled.withColumn("_d", F.hypot(F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w)))
    return moved.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_bps") * F.col("_weight")), F.sum("_weight")).alias("decay_cost_bps"), F.sum("_d").alias("impact_length"))


def order_flow_imbalance(wide: DataFrame, root: str, order: str, keys: list[str]) -> DataFrame:
    """Adds {root}_ofi of the first level, by the published definition (changes of bid and ask queues), within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    b, bq, a, aq = (F.col(f"{root}_{x}_1") for x in ("bidprice", "bidquantity", "askprice", "askquantity"))
    was = lambda c: F.lag(c).over(w)
    bid = F.when(b >= was(b), bq).otherwise(0.0) - F.when(b <= was(b), was(bq)).otherwise(0.0)
    ask = F.when(a <= was(a), aq).otherwise(0.0) - F.when(a >= was(a), was(aq)).otherwise(0.0)
    return wide.withColumn(f"{root}_ofi", F.when(was(b).isNotNull() & was(a).isNotNull() & b.isNotNull() & a.isNotNull(), bid - ask))
