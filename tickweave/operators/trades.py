"""The trade tape: scrub, sign, bucket, attach to a grid, join assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tickweave.functions.series import declared_sign
from tickweave.operators.blocks import carried, ticks
from tickweave.staging import staged

DAY_US = 86_400_000_000


def scrub(trades: DataFrame, breaks: DataFrame | None, corrections: DataFrame | None, keys: tuple[str, ...] = ("matchid", "tradereferencenumber"), by: list[str] = ()) -> DataFrame:
    """Trades without broken prints, with corrected price and quantity, and ``corrected`` (0/1). ``by``: columns that tell tapes apart.

    The key is the first of ``keys`` that both frames have. corrections need
    newprice, newquantity and arrival: the last one of a print wins, each value
    only if finite.
    """
    out = trades
    key = next((k for k in keys if breaks is not None and k in trades.columns and k in breaks.columns), None)
    if key:
        out = out.join(breaks.select(*by, key).where(F.col(key).isNotNull()).distinct(), [*by, key], "left_anti")
    if corrections is None or "matchid" not in out.columns:
        return out.withColumn("corrected", F.lit(0))
    last = corrections.where("matchid is not null").groupBy(*by, "matchid").agg(F.max(F.struct("arrival", "newprice", "newquantity")).alias("_new"))
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    new = lambda c, old: F.when(ok(F.col(f"_new.{c}")), F.col(f"_new.{c}")).otherwise(F.col(old))
    joined = out.join(last, [*by, "matchid"], "left")
    return joined.withColumn("price", new("newprice", "price")).withColumn("quantity", new("newquantity", "quantity")).withColumn("corrected", F.col("_new").isNotNull().cast("int")).drop("_new")


def scrub_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """n0, broken, corrected (trade rows)."""
    n0 = before.agg(F.count("*").alias("n0"))
    n1 = after.agg(F.count("*").alias("_n1"), F.coalesce(F.sum("corrected"), F.lit(0)).alias("corrected"))
    return n0.join(n1).select("n0", (F.col("n0") - F.col("_n1")).alias("broken"), "corrected")


def scrub_counted(trades: DataFrame, breaks: DataFrame, corrections: DataFrame, key: str = "matchid") -> tuple[DataFrame, Observation]:
    """(scrub()'s trades, their counters n0, broken, corrected, no_price): counted as the trades pass by, without a pass of their own.

    The counters are there when an action on the trades has run.
    """
    counters = Observation()
    gone = breaks.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_broken", F.lit(True))
    marked = scrub(trades, None, corrections).join(gone, key, "left").withColumn("_broken", F.coalesce("_broken", F.lit(False)))
    n = lambda c: F.count(F.when(c, 1))
    seen = marked.observe(counters, F.count("*").alias("n0"), n(F.col("_broken")).alias("broken"), n((F.col("corrected") == 1) & ~F.col("_broken")).alias("corrected"), n(F.col("price").isNull()).alias("no_price"))
    return seen.where("not _broken").drop("_broken"), counters


def printable_only(trades: DataFrame) -> DataFrame:
    return trades.where(~F.trim("printable").eqNullSafe(F.lit("NonPrintable")))


def signed(trades: DataFrame, order: list[str], block: Column, how: str | list[tuple[Column, str]] = "aggressor", buy_label: str = "Bid", price: str = "price", by: list[str] = ()) -> DataFrame:
    """Adds ``sign``: +1 buy, -1 sell, 0 unknown; tick rule over the whole tape (of each ``by``) where a row says nothing.

    ``block`` cuts the order of ``order`` into blocks (it must grow with it). ``how``: for all rows, or (condition, how) pairs.
    """
    col = lambda c: F.col(c) if c in trades.columns else None
    cut = ticks(trades.withColumn("_block", block), price, order, "_block", "_tick", by)
    declared = lambda h: declared_sign(h, col("aggressorside"), col("side"), buy_label)
    own = declared(how) if isinstance(how, str) else F.coalesce(*[F.when(c, declared(h)) for c, h in how])
    return cut.withColumn("sign", F.coalesce(own, F.col("_tick").cast("int"), F.lit(0))).drop("_block", "_tick")


def bucket_us(ts_us: Column, step_us: int, tz: str = "UTC") -> Column:
    """Start (epoch microseconds) of the bucket, counted from local midnight; the step must divide a day."""
    if DAY_US % step_us:
        raise ValueError("the interval does not divide a day")
    local = F.from_utc_timestamp(F.timestamp_micros(ts_us), tz)
    midnight = F.unix_micros(F.to_utc_timestamp(F.date_trunc("day", local), tz))
    return midnight + F.floor((ts_us - midnight) / step_us).cast("long") * step_us


def dense(buckets: DataFrame, step_us: int, zero: list[str], bucket: str = "bucket_us") -> DataFrame:
    """All buckets from the first to the last; absent ones have 0 in ``zero`` and null elsewhere.

    The aggregated buckets are staged, so that the tape is read for them once.
    """
    buckets = staged(buckets, "buckets")
    ends = buckets.agg(F.min(bucket).alias("a"), F.max(bucket).alias("b")).where("a is not null")
    grid = ends.select(F.explode(F.sequence("a", "b", F.lit(step_us).cast("long"))).alias(bucket))
    return grid.join(buckets, bucket, "left").fillna(0, zero)


def trade_buckets(trades: DataFrame, step_us: int, order: list[str], ts_us: str = "ts_us", price: str = "price", qty: str = "quantity", tz: str = "UTC", by: list[str] | None = None) -> DataFrame:
    """Signed trades by bucket: counts, volumes, last price and VWAP. Buckets are dense; with ``by`` (columns that tell tapes apart) only those with trades."""
    q, p, s = F.col(qty), F.col(price), F.col("sign")
    got = trades.withColumn("bucket_us", bucket_us(F.col(ts_us), step_us, tz)).groupBy(*(by or []), "bucket_us").agg(
        F.count(q).alias("trade_count"), F.sum(q).alias("trade_volume"),
        F.sum((s > 0).cast("long")).alias("trade_buy"), F.sum((s < 0).cast("long")).alias("trade_sell"),
        F.sum(F.when(s > 0, q)).alias("trade_buy_volume"), F.sum(F.when(s < 0, q)).alias("trade_sell_volume"),
        F.max(F.when(p.isNotNull(), F.struct(*order, p.alias("p"))))["p"].alias("last_trade_price"),
        F.try_divide(F.sum(p * q), F.sum(F.when(p.isNotNull(), q))).alias("trade_vwap"),
    )
    return got if by is not None else dense(got, step_us, ["trade_count", "trade_buy", "trade_sell"])


def message_buckets(msgs: DataFrame, step_us: int, order: list[str], trade: bool = False, ts_us: str = "ts_us", qty: str = "quantity", tz: str = "UTC") -> DataFrame:
    """Messages by dense bucket. msg_count counts quantities, the side counts count rows."""
    q, bid, ask = F.col(qty), F.trim("side") == "Bid", F.trim("side") == "Ask"
    aggs = [
        F.count(q).alias("msg_count"), F.sum(q).alias("total_quantity"),
        F.count(F.when(bid, 1)).alias("bid_msg_count"), F.count(F.when(ask, 1)).alias("ask_msg_count"),
        F.sum(F.when(bid, q)).alias("bid_quantity"), F.sum(F.when(ask, q)).alias("ask_quantity"),
    ]
    if trade:
        p = F.col("price")
        aggs += [F.max(F.when(p.isNotNull(), F.struct(*order, p.alias("p"))))["p"].alias("last_trade_price"), F.try_divide(F.sum(p * q), F.sum(q)).alias("trade_vwap")]
    got = msgs.withColumn("bucket_us", bucket_us(F.col(ts_us), step_us, tz)).groupBy("bucket_us").agg(*aggs)
    return dense(got, step_us, ["msg_count", "bid_msg_count", "ask_msg_count"])


FLOW = {"trade_buy": "trade_buy", "trade_sell": "trade_sell", "trade_buy_volume": "trade_buy_volume", "trade_sell_volume": "trade_sell_volume", "last_trade_price": "trade_px", "trade_vwap": "trade_vwap"}


def flow(buckets: DataFrame, root: str, price_scale: float = 1.0) -> DataFrame:
    """Bucketed trades as {root}_trade_buy, _sell, _buy_volume, _sell_volume, _px, _vwap."""
    scaled = lambda c, n: F.col(c) * price_scale if n in ("trade_px", "trade_vwap") else F.col(c)
    return buckets.select("bucket_us", *[scaled(c, n).alias(f"{root}_{n}") for c, n in FLOW.items()])


def flow_wide(buckets: DataFrame, roots: list[tuple[str, Column, float]], by: list[str] = ()) -> DataFrame:
    """Buckets of several tapes (trade_buckets with ``by``) as flow() columns side by side: one row for each (by, bucket_us) with trades of any.

    roots: of each tape its root, the condition that its buckets meet, and its price scale.
    """
    cells = []
    for root, own, scale in roots:
        for c, n in FLOW.items():
            cells.append(F.max(F.when(own, F.col(c) * scale if n in ("trade_px", "trade_vwap") else F.col(c))).alias(f"{root}_{n}"))
    return buckets.groupBy(*by, "bucket_us").agg(*cells)


def flow_count_columns(roots: list[str]) -> list[str]:
    """The columns of flow() that are 0 where there are no trades."""
    return [f"{r}_{n}" for r in roots for n in FLOW.values() if n not in ("trade_px", "trade_vwap")]


def attach_flow(grid: DataFrame, flows: list[DataFrame], step_us: int, label: str = "start") -> DataFrame:
    """grid(ts_us, ..) with flows joined on the bucket's start (or end); counts and volumes 0 where absent, prices null."""
    out = grid
    for one in flows:
        at = F.col("bucket_us") + (step_us if label == "end" else 0)
        counts = [c for c in one.columns if c.rpartition("_trade_")[2] in ("buy", "sell", "buy_volume", "sell_volume")]
        out = out.join(one.withColumn("ts_us", at).drop("bucket_us"), "ts_us", "left").fillna(0, counts)
    return out


def join_assets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two assets on one time axis (full outer), in order of time."""
    return a.join(b, "ts_us", "full_outer").orderBy("ts_us")


def flow_counts(frame: DataFrame, assets: list[str], block: Column) -> DataFrame | None:
    """ts_us with {a}_buy, {a}_sell (null is 0) and {a}_ret_bps (log returns of the filled price), or None if columns are absent."""
    if any(f"{a}_trade_buy" not in frame.columns for a in assets):
        return None
    px = {a: f"{a}_trade_px" if f"{a}_trade_px" in frame.columns else f"{a}_trade_vwap" for a in assets}
    out = carried(frame.withColumn("_block", block), list(px.values()), ["ts_us"], "_block")
    x = lambda c: F.when(F.col(c) > 1e-12, F.ln(c))
    cells = []
    for a in assets:
        cells += [F.coalesce(f"{a}_trade_buy", F.lit(0)).alias(f"{a}_buy"), F.coalesce(f"{a}_trade_sell", F.lit(0)).alias(f"{a}_sell")]
        cells.append(((x(f"{px[a]}_filled") - x(f"{px[a]}_was")) * 1e4).alias(f"{a}_ret_bps"))
    return out.select("ts_us", *cells)


def has_trade_flow(columns: list[str], assets: list[str]) -> bool:
    return all(f"{a}_trade_buy" in columns for a in assets)
