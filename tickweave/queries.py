"""Registered queries over the driver's tables, each with DuckDB SQL of the same meaning.

The adapters below read ``events`` and ``lineitem`` as market data (SURVEY 7.6).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions import calendar, features
from tickweave.operators import blocks, book, checks, ladder, replay_checks, trades
from tickweave.operators.ordering import ordered_events
from tickweave.staging import staged

HOUR_US = 3_600_000_000
G0_US, POINTS = 1_704_067_200_000_000, 721  # 2024-01-01 UTC, hourly through 30 days


def r6(c: Column) -> Column:
    return F.round(c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts_us, user_id, event_type, value, k."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return df.select("event_id", us.alias("ts_us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


EV = """ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).where("event_type = 'purchase'")
    k = F.col("k").cast("long")
    return df.select("event_id", "ts_us", "user_id", F.col("value").alias("price"), F.col("k").alias("quantity"), F.col("event_id").alias("matchid"), F.when(k % 3 == 0, " Buy").when(k % 3 == 1, "SELL ").alias("aggressorside"), F.when(k % 4 == 0, "Bid").when(k % 4 == 1, "Ask").when(k % 4 == 2, "?").alias("side"), F.when(k % 10 == 9, "NonPrintable").otherwise("Printable").alias("printable"))


TAPE = EV + """, tape0 AS (SELECT event_id, ts_us, user_id, value AS price, k AS quantity,
  CASE WHEN k % 3 = 0 THEN ' Buy' WHEN k % 3 = 1 THEN 'SELL ' END AS aggressorside,
  CASE WHEN k % 4 = 0 THEN 'Bid' WHEN k % 4 = 1 THEN 'Ask' WHEN k % 4 = 2 THEN '?' END AS side,
  CASE WHEN k % 10 = 9 THEN 'NonPrintable' ELSE 'Printable' END AS printable
  FROM ev WHERE event_type = 'purchase'),
tape AS (SELECT * FROM tape0 WHERE trim(printable) <> 'NonPrintable'),
stepped AS (SELECT *, nullif(sign(price - lag(price) OVER (ORDER BY event_id)), 0) AS step FROM tape),
ticked AS (SELECT *, coalesce(last_value(step IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS tick FROM stepped)"""

ORDER = ["event_id"]


def day_block() -> Column:
    return F.floor(F.col("ts_us") / (24 * HOUR_US))


def signs(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    return trades.signed(trades.printable_only(tape(spark, sf_dir)), ORDER, day_block(), how)


def trade_sign(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signs(spark, sf_dir, how).select("event_id", F.col("sign").cast("long").alias("sign"))

    return query


SIGN = {
    "aggressor": "CASE WHEN lower(trim(aggressorside)) = 'buy' THEN 1 WHEN lower(trim(aggressorside)) = 'sell' THEN -1 ELSE tick END",
    "side": "CASE WHEN trim(side) = 'Bid' THEN 1 WHEN trim(side) = 'Ask' THEN -1 ELSE tick END",
    "tick": "tick",
}


def trade_bucket_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trades.trade_buckets(signs(spark, sf_dir, "tick"), HOUR_US, ORDER)
    return got.select("bucket_us", "trade_count", "trade_buy", "trade_sell", *[r6(F.col(c)).alias(c) for c in ("trade_volume", "trade_buy_volume", "trade_sell_volume", "last_trade_price", "trade_vwap")])


BUCKETED = """b AS (SELECT ts_us - ts_us % 3600000000 AS bucket_us, count(quantity) AS trade_count, sum(quantity) AS trade_volume,
  count(*) FILTER (WHERE sign > 0) AS trade_buy, count(*) FILTER (WHERE sign < 0) AS trade_sell,
  sum(quantity) FILTER (WHERE sign > 0) AS trade_buy_volume, sum(quantity) FILTER (WHERE sign < 0) AS trade_sell_volume,
  arg_max(price, event_id) AS last_trade_price, sum(price * quantity) / sum(quantity) AS trade_vwap FROM s GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(bucket_us) FROM b), (SELECT max(bucket_us) FROM b), 3600000000)) AS bucket_us)"""


def msg_bucket_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("event_id", "ts_us", F.when(F.col("user_id") % 2 == 0, " Bid").otherwise("Ask").alias("side"), F.when(F.col("k") >= 10, F.col("k")).alias("quantity"), F.col("value").alias("price"))
    got = trades.message_buckets(df, HOUR_US, ORDER, trade=True)
    return got.select("bucket_us", "msg_count", "bid_msg_count", "ask_msg_count", *[r6(F.col(c)).alias(c) for c in ("total_quantity", "bid_quantity", "ask_quantity", "last_trade_price", "trade_vwap")])


def scrubbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tape(spark, sf_dir)
    breaks = t.where(F.col("event_id") % 97 == 0).select("matchid")
    fixes = t.where(F.col("event_id") % 89 == 0)
    one = fixes.select("matchid", F.lit(0).alias("arrival"), F.lit(1.0).alias("newprice"), F.lit(2.0).alias("newquantity"))
    two = fixes.select("matchid", F.lit(1).alias("arrival"), (F.col("price") + 1).alias("newprice"), F.when(F.col("event_id") % 2 == 0, F.lit(50.0)).alias("newquantity"))
    return t, trades.scrub(t, breaks, one.unionByName(two))


def trade_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrubbed(spark, sf_dir)[1].select("event_id", r6(F.col("price")).alias("price"), "quantity", F.col("corrected").cast("long").alias("corrected"))


def trade_scrub_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.scrub_stats(*scrubbed(spark, sf_dir))


SCRUB = EV + """, t AS (SELECT event_id, value AS price, k AS quantity FROM ev WHERE event_type = 'purchase'),
s AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN price + 1 ELSE price END AS price,
  CASE WHEN event_id % 89 = 0 AND event_id % 2 = 0 THEN 50.0 ELSE quantity END AS quantity,
  CAST(event_id % 89 = 0 AS BIGINT) AS corrected FROM t WHERE event_id % 97 <> 0)"""


def asset_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_us and the flow of two assets, A and B (by the user's parity): both tapes in one pass."""
    t = trades.printable_only(tape(spark, sf_dir)).withColumn("asset", F.col("user_id") % 2)
    buckets = trades.trade_buckets(trades.signed(t, ORDER, day_block(), "tick", by=["asset"]), HOUR_US, ORDER, by=["asset"])
    return trades.flow_wide(buckets, [(n, F.col("asset") == k, 1.0) for k, n in enumerate("AB")]).withColumnRenamed("bucket_us", "ts_us")


def flow_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(POINTS).select((F.lit(G0_US) + F.col("id") * HOUR_US).alias("ts_us"))
    frame = staged(grid.join(asset_flows(spark, sf_dir), "ts_us", "left").fillna(0, trades.flow_count_columns(["A", "B"])), "flow")
    got = trades.flow_counts(frame, ["A", "B"], day_block())
    return got.select("ts_us", "A_buy", "A_sell", r6(F.col("A_ret_bps")).alias("A_ret_bps"), "B_buy", "B_sell", r6(F.col("B_ret_bps")).alias("B_ret_bps"))


def _asset_sql(parity: int, n: str) -> str:
    return f"""x{n}t AS (SELECT * FROM tape WHERE user_id % 2 = {parity}),
x{n}s AS (SELECT *, nullif(sign(price - lag(price) OVER (ORDER BY event_id)), 0) AS step FROM x{n}t),
x{n}k AS (SELECT *, coalesce(last_value(step IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS sign FROM x{n}s),
x{n}b AS (SELECT ts_us - ts_us % 3600000000 AS ts_us, count(*) FILTER (WHERE sign > 0) AS {n}_buy, count(*) FILTER (WHERE sign < 0) AS {n}_sell,
  arg_max(price, event_id) AS px FROM x{n}k GROUP BY 1),
x{n}g AS (SELECT g.ts_us, coalesce({n}_buy, 0) AS {n}_buy, coalesce({n}_sell, 0) AS {n}_sell,
  last_value(px IGNORE NULLS) OVER (ORDER BY g.ts_us ROWS UNBOUNDED PRECEDING) AS px FROM grid g LEFT JOIN x{n}b USING (ts_us)),
x{n}r AS (SELECT ts_us, {n}_buy, {n}_sell, round((ln(px) - lag(ln(px)) OVER (ORDER BY ts_us)) * 1e4, 6) AS {n}_ret_bps FROM x{n}g)"""


GRID_SQL = f"grid AS (SELECT {G0_US} + i * 3600000000 AS ts_us FROM range({POINTS}) t(i))"


def session_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = staged(asset_flows(spark, sf_dir), "flows")
    pick = lambda n: flows.where(F.col(f"{n}_trade_px").isNotNull()).select("ts_us", f"{n}_trade_buy", r6(F.col(f"{n}_trade_px")).alias(f"{n}_trade_px"))
    return trades.join_assets(pick("A"), pick("B"))


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders from lineitem: the order is the book, its distinct lines by unit price the levels."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"))
    w = Window.partitionBy("l_orderkey").orderBy("p", "l_linenumber")
    return li.select("l_orderkey", F.col("p").alias("price"), F.when(F.col("l_linenumber") % 5 == 0, None).otherwise(F.col("q")).alias("qty"), "flag", F.row_number().over(w).alias("level"))


LADDERS = """li AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price, max(l_quantity) AS q, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
lad AS (SELECT l_orderkey, price, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE q END AS qty, flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY price, l_linenumber) AS level FROM li)"""


def vwap_to_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.vwap_to_lot(ladders(spark, sf_dir), ["l_orderkey"], 60.0)
    return got.select("l_orderkey", r6(F.col("vwap")).alias("vwap"), r6(F.col("filled")).alias("filled"), "levels_used")


def features_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ladders(spark, sf_dir).where("qty is not null")
    bid = F.max(F.when(F.col("flag") != "R", F.struct("price", "qty")))
    ask = F.min(F.when(F.col("flag") == "R", F.struct("price", "qty")))
    two = df.groupBy("l_orderkey").agg(bid.alias("b"), ask.alias("a")).where("b is not null and a is not null")
    b, bq, a, aq = F.col("b.price"), F.col("b.qty"), F.col("a.price"), F.col("a.qty")
    return two.select("l_orderkey", r6(features.mid(b, a)).alias("mid"), r6(features.microprice(b, bq, a, aq)).alias("wmid"), r6(features.spread_bps(b, a)).alias("spread_bps"))


def side_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.side_costs(ladders(spark, sf_dir), ["l_orderkey"])
    return got.select("l_orderkey", r6(F.col("decay_cost_bps")).alias("decay_cost_bps"), r6(F.col("impact_length")).alias("impact_length"))


def order_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))
    wide = df.select("l_orderkey", "l_linenumber", F.floor(F.col("p") / 10000).cast("double").alias("X_bidprice_1"), F.col("q").alias("X_bidquantity_1"), (F.floor(F.col("p") / 8000) + 1).cast("double").alias("X_askprice_1"), (F.col("q") + 1).alias("X_askquantity_1"))
    got = features.order_flow_imbalance(wide, "X", "l_linenumber", ["l_orderkey"])
    return got.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), r6(F.col("X_ofi")).alias("ofi"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct()


def third_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = order_days(spark, sf_dir).select(F.year("d").alias("y"), F.month("d").alias("m")).distinct()
    return months.select(F.col("y").cast("long").alias("y"), F.col("m").cast("long").alias("m"), calendar.third_friday(F.col("y"), F.col("m")).cast("string").alias("third_friday"))


def front_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = calendar.front_month(F.lit("ES"), F.col("d"))
    return order_days(spark, sf_dir).select(F.col("d").cast("string").alias("d"), front.alias("contract"), calendar.front_expiry(F.col("d")).cast("string").alias("expiry"))


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a message log: three feeds, own sequences, a clock that goes back now and then."""
    e = events(spark, sf_dir)
    types = {"signup": "mt_add_order", "click": "mt_modify_order", "error": "mt_cancel_order", "purchase": "mt_trade", "view": "mt_price_level_update"}
    kind = F.lit(None).cast("string")
    for a, b in types.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    k, u, i = F.col("k").cast("long"), F.col("user_id"), F.col("event_id")
    return e.select(
        kind.alias("message_type"), F.concat(F.lit("F"), (u % 3).cast("string")).alias("f"), F.when(u % 2 == 0, "Bid").when(k % 50 == 7, "?").otherwise("Ask").alias("side"),
        F.when(k == 13, None).otherwise(F.col("value")).alias("price"), (F.col("k") + 1).alias("qty"), F.when(k % 20 == 3, None).otherwise(u.cast("string")).alias("ref"),
        F.when(i % 33 != 0, i).alias("seq"), ((F.col("ts_us") - (i * 37 % 11) * 1_000_000_000) * 1000).alias("ts_ns"), i.alias("arrival"),
    )


MSGS = EV + """, msgs AS (SELECT CASE event_type WHEN 'signup' THEN 'mt_add_order' WHEN 'click' THEN 'mt_modify_order' WHEN 'error' THEN 'mt_cancel_order'
  WHEN 'purchase' THEN 'mt_trade' WHEN 'view' THEN 'mt_price_level_update' END AS message_type, 'F' || (user_id % 3) AS f,
  CASE WHEN user_id % 2 = 0 THEN 'Bid' WHEN k % 50 = 7 THEN '?' ELSE 'Ask' END AS side, CASE WHEN k = 13 THEN NULL ELSE value END AS price, k + 1 AS qty,
  CASE WHEN k % 20 = 3 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS ref, CASE WHEN event_id % 33 <> 0 THEN event_id END AS seq,
  (ts_us - (event_id * 37 % 11) * 1000000000) * 1000 AS ts_ns, event_id AS arrival FROM ev)"""


def type_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.inventory(msgs(spark, sf_dir))


def feed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.feed_matrix(msgs(spark, sf_dir)).select("f", "mt_add_order", "mt_cancel_order", "mt_trade", "mt_modify_order", "mt_price_level_update")


def field_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = checks.field_health(msgs(spark, sf_dir))
    return got.select("f", "n", *[r6(F.col(c)).alias(c) for c in ("side_ok", "bad_price", "bad_qty", "no_ref", "median_price")])


def side_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.side_tokens(msgs(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def seq_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sequence_continuity(msgs(spark, sf_dir)).select("f", "span", "present", r6(F.col("missing")).alias("missing"))


def clock_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.clock_inversions(msgs(spark, sf_dir))


LO_NS, HI_NS = G0_US * 1000, (G0_US + 20 * 24 * HOUR_US) * 1000


def clock_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.clock_health(msgs(spark, sf_dir), LO_NS, HI_NS)


def frame_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.frame_findings(msgs(spark, sf_dir), LO_NS, HI_NS).withColumn("value", r6(F.col("value")))


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = checks.verdict(checks.frame_findings(msgs(spark, sf_dir), LO_NS, HI_NS))
    return got.select("verdict", F.col("rc").cast("long").alias("rc"), "data", "code")


def book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as order-book events; trades without a price, so no level is hit by price alone."""
    e = events(spark, sf_dir)
    code = F.col("event_type")
    for a, b in {"signup": "ADD", "click": "MODIFY", "error": "CANCEL", "purchase": "TRADE", "view": "LEVEL_SET"}.items():
        code = F.when(F.col("event_type") == a, b).otherwise(code)
    k, u, i = F.col("k").cast("long"), F.col("user_id"), F.col("event_id")
    level, modify = F.col("event_type") == "view", F.col("event_type") == "click"
    return e.select(
        F.when(level, "LVL").otherwise(F.concat(F.lit("F"), (u % 3).cast("string"))).alias("f"), code.alias("code"), F.when(u % 2 == 0, "Bid").otherwise("Ask").alias("side"),
        F.when(F.col("event_type") != "purchase", F.round("value") + F.when(u % 2 == 0, 0).otherwise(8)).cast("double").alias("price"),
        F.when(level & (k % 4 == 0), 0.0).otherwise(F.col("k") + 1).alias("qty"), F.when(modify & (k % 5 == 0), u + 3).otherwise(u).cast("string").alias("ref"),
        u.cast("string").alias("prev_ref"), (k % 2 == 0).alias("maintain"), i.alias("seq"), ((F.col("ts_us") - (i * 37 % 11) * 1_000_000_000) * 1000).alias("ts_ns"), i.alias("arrival"),
    )


BOOK = EV + """, be AS (SELECT CASE WHEN event_type = 'view' THEN 'LVL' ELSE 'F' || (user_id % 3) END AS f,
  CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'click' THEN 'MODIFY' WHEN 'error' THEN 'CANCEL' WHEN 'purchase' THEN 'TRADE' ELSE 'LEVEL_SET' END AS code,
  CASE WHEN user_id % 2 = 0 THEN 'Bid' ELSE 'Ask' END AS side, CASE WHEN event_type <> 'purchase' THEN round(value) + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 8 END END AS price,
  CASE WHEN event_type = 'view' AND k % 4 = 0 THEN 0.0 ELSE k + 1 END AS qty, CASE WHEN event_type = 'click' AND k % 5 = 0 THEN user_id + 3 ELSE user_id END AS ref,
  user_id AS prev_ref, k % 2 = 0 AS maintain, event_id, (ts_us - (event_id * 37 % 11) * 1000000000) * 1000 AS ts_ns FROM ev),
o AS (SELECT *, max(ts_ns) OVER (PARTITION BY f ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts FROM be)"""

LIFE = BOOK + """, st AS (SELECT f, event_id, 1 AS sub, 'SET' AS op, ref AS key, side, price, qty, code, eff_ts, ts_ns FROM o WHERE code = 'ADD' OR code = 'MODIFY'
  UNION ALL SELECT f, event_id, 0, 'DEL', ref, side, price, qty, code, eff_ts, ts_ns FROM o WHERE code = 'CANCEL'
  UNION ALL SELECT f, event_id, 0, 'RED', ref, side, price, qty, code, eff_ts, ts_ns FROM o WHERE code = 'TRADE'
  UNION ALL SELECT f, event_id, 0, 'DEL', prev_ref, side, price, qty, code, eff_ts, ts_ns FROM o WHERE code = 'MODIFY' AND prev_ref <> ref),
gn AS (SELECT *, sum(CASE WHEN op = 'RED' THEN 0 ELSE 1 END) OVER (PARTITION BY f, key ORDER BY event_id, sub ROWS UNBOUNDED PRECEDING) AS gen FROM st),
sz AS (SELECT *, first_value(CASE WHEN op = 'SET' THEN qty ELSE 0 END) OVER g AS size, first_value(CASE WHEN op = 'SET' THEN side END) OVER g AS gside,
  first_value(CASE WHEN op = 'SET' THEN price END) OVER g AS gprice, sum(CASE WHEN op = 'RED' THEN qty ELSE 0 END) OVER g AS taken FROM gn
  WINDOW g AS (PARTITION BY f, key, gen ORDER BY event_id, sub ROWS UNBOUNDED PRECEDING)),
af AS (SELECT *, CASE WHEN gen > 0 AND size - taken > 1e-9 THEN size - taken ELSE 0 END AS after FROM sz),
life0 AS (SELECT *, coalesce(lag(after) OVER w, 0) AS before, lag(gside) OVER w AS was_side, lag(gprice) OVER w AS was_price FROM af WINDOW w AS (PARTITION BY f, key ORDER BY event_id, sub)),
life AS (SELECT *, coalesce(last_value(CASE WHEN op = 'SET' THEN 0 WHEN code IN ('CANCEL', 'TRADE') AND before > 0 AND after <= 0 THEN 1 END IGNORE NULLS)
  OVER (PARTITION BY f, key ORDER BY event_id, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS killed FROM life0)"""

LEVELS = LIFE + """, dl AS (SELECT f, event_id, sub * 2 AS sub, eff_ts, was_side AS side, was_price AS price, CASE WHEN op = 'RED' AND after > 0 THEN after - before ELSE -before END AS delta FROM life WHERE before > 0
  UNION ALL SELECT f, event_id, sub * 2 + 1, eff_ts, side, price, qty FROM life WHERE op = 'SET'),
lv AS (SELECT f, side, price, event_id, sub, eff_ts, sum(delta) OVER (PARTITION BY f, side, price ORDER BY event_id, sub ROWS UNBOUNDED PRECEDING) AS level FROM dl
  UNION ALL SELECT f, side, price, event_id, 0, eff_ts, qty FROM o WHERE code = 'LEVEL_SET')"""

SPANS = LEVELS + f""", pl AS (SELECT *, greatest(0, CAST(ceil((eff_ts - {G0_US * 1000}) / 3600000000000.0) AS BIGINT)) AS gi FROM lv),
ls AS (SELECT f, side, price, gi, arg_max(level, (event_id, sub)) AS qty FROM pl WHERE gi < {POINTS} GROUP BY 1, 2, 3, 4),
iv AS (SELECT f, side, price, qty, gi AS lo, coalesce(lead(gi) OVER (PARTITION BY f, side, price ORDER BY gi), {POINTS}) AS hi FROM ls),
cell AS (SELECT f, side, price, qty, unnest(range(lo, hi)) AS gi FROM iv WHERE qty > 1e-9),
agg AS (SELECT gi, side, price, sum(qty) AS qty FROM cell GROUP BY 1, 2, 3),
lad AS (SELECT gi, side, row_number() OVER (PARTITION BY gi, side ORDER BY CASE WHEN side = 'Bid' THEN -price ELSE price END) AS level, price, qty FROM agg)"""
TOP = SPANS + """, top AS (SELECT gi, max(price) FILTER (WHERE side = 'Bid' AND level = 1) AS bid1, max(price) FILTER (WHERE side = 'Ask' AND level = 1) AS ask1 FROM lad GROUP BY 1)"""


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_seq = ordered_events(book_events(spark, sf_dir)).select(F.col("arrival").alias("event_id"), "f", F.expr("eff_ts div 1000").alias("eff_ts_us"))
    by_clock = ordered_events(book_events(spark, sf_dir), "clock").withColumn("_day", F.expr(f"k1 div {24 * HOUR_US * 1000}L"))
    ranked = blocks.ranked(by_clock, ["k1", "k2", "arrival"], "_day", "clock_rank", ["f"])
    return by_seq.join(ranked.select(F.col("arrival").alias("event_id"), "clock_rank"), "event_id")


def ordered_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in order: this is done once for all that a query asks of them."""
    return staged(ordered_events(book_events(spark, sf_dir)), "ordered")


def lob_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = book.levels(ordered_book(spark, sf_dir))
    return got.select("f", "side", "price", F.col("arrival").alias("event_id"), F.col("sub").cast("long").alias("sub"), r6(F.col("level")).alias("level"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of all levels."""
    return ladder.intervals(book.levels(ordered_book(spark, sf_dir)), G0_US * 1000, HOUR_US * 1000, POINTS)


def lob_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.ladder(spans(spark, sf_dir), 5).select("gi", "side", F.col("level").cast("long").alias("level"), "price", r6(F.col("qty")).alias("qty"))


def lob_nbbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.nbbo(spans(spark, sf_dir), 60.0)


def lob_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    wide = ladder.wide_book(spark, ladder.ladder(s, 2), ladder.nbbo(s, 60.0), "X", 2, POINTS, G0_US, HOUR_US)
    return wide.select(F.unix_micros("ts").alias("ts_us"), "X_bidprice_1", r6(F.col("X_bidquantity_1")).alias("X_bidquantity_1"), "X_askprice_2", r6(F.col("X_askquantity_2")).alias("X_askquantity_2"), "X_mid", "X_nbbo_bid", "X_nbbo_ask")


def lob_crossed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.crossed_rate(spans(spark, sf_dir), POINTS).select("points", "crossed", "locked_or_crossed", r6(F.col("rate")).alias("rate"))


def lob_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.replay_stats(ordered_book(spark, sf_dir))


def resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.resting(ordered_book(spark, sf_dir)).select("f", "ref", "side", "price", r6(F.col("size")).alias("size"))


def orphan_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay_checks.orphans(ordered_book(spark, sf_dir))
    return got.select(F.col("arrival").alias("event_id"), "f", "code", "ref", F.col("add_present").cast("long").alias("add_present"), F.col("on_other_feed").cast("long").alias("on_other_feed"))


def resurrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.resurrections(ordered_book(spark, sf_dir)).select(F.col("arrival").alias("event_id"), "f", "ref")


def resting_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.resting_series(ordered_book(spark, sf_dir), G0_US * 1000, HOUR_US * 1000, POINTS)


def resting_sextiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay_checks.sextiles(resting_series(spark, sf_dir), "resting", POINTS)
    return got.select(F.col("sextile").cast("long").alias("sextile"), r6(F.col("mean")).alias("mean"))


def feed_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.feed_crossings(spans(spark, sf_dir))


def pinned_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.pins(feed_crossings(spark, sf_dir))


def wrong_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.wrong_side(ordered_book(spark, sf_dir)).select("f", "ref", "side", "price", r6(F.col("size")).alias("size"))


def ordering_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay_checks.ordering_ab(book_events(spark, sf_dir), G0_US * 1000, HOUR_US * 1000, POINTS)
    return got.select(r6(F.col("clock_rate")).alias("clock_rate"), r6(F.col("sequence_rate")).alias("sequence_rate"))


def replay_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.replay_findings(book_events(spark, sf_dir), G0_US * 1000, HOUR_US * 1000, POINTS).withColumn("value", r6(F.col("value")))


def snapshot_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    wide = ladder.wide_book(spark, ladder.ladder(s, 2), ladder.nbbo(s), "X", 2, POINTS, G0_US, HOUR_US)
    hour = (F.unix_micros("ts") / HOUR_US).cast("long")
    other = wide.where(hour % 10 != 0).withColumn("X_bidprice_1", F.col("X_bidprice_1") + F.when(hour % 7 == 0, 1.0).otherwise(0.0))
    got = ladder.validate(wide, other, "X", 2)
    return got.select("field", "n", r6(F.col("match_rate")).alias("match_rate"), r6(F.col("mean_abs_diff")).alias("mean_abs_diff"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        trade_bucket_agg, msg_bucket_agg, trade_scrub, trade_scrub_stats, flow_attach, session_outer_join, vwap_to_lot, features_l1, side_costs, order_flow_imbalance, third_friday, front_month,
        type_inventory, feed_matrix, field_health, side_tokens, seq_continuity, clock_inversions, clock_health, frame_findings, verdict,
        event_order, lob_levels, lob_ladder, lob_nbbo, lob_wide, lob_crossed_rate, lob_stats, resting_orders, orphan_provenance, resurrections, resting_series,
        resting_sextiles, feed_crossings, pinned_prices, wrong_side, ordering_ab, replay_findings, snapshot_validate,
    )
} | {f"trade_sign_{how}": trade_sign(how) for how in SIGN}

_EXPIRY = "CASE WHEN isodow(make_date({y}, {m}, 1)) <= 5 THEN make_date({y}, {m}, 20 - isodow(make_date({y}, {m}, 1))) ELSE make_date({y}, {m}, 27 - isodow(make_date({y}, {m}, 1))) END"
_CONTRACTS = ", ".join(f"('{c}', {calendar.MONTH_CODES[c]})" for c in calendar.QUARTERLY)

ORACLES: dict[str, str] = {
    **{f"trade_sign_{how}": f"WITH {TAPE} SELECT event_id, CAST({sql} AS BIGINT) AS sign FROM ticked" for how, sql in SIGN.items()},
    "trade_bucket_agg": f"WITH {TAPE}, s AS (SELECT *, tick AS sign FROM ticked), {BUCKETED} SELECT bucket_us, coalesce(trade_count, 0) AS trade_count, coalesce(trade_buy, 0) AS trade_buy, coalesce(trade_sell, 0) AS trade_sell, round(trade_volume, 6) AS trade_volume, round(trade_buy_volume, 6) AS trade_buy_volume, round(trade_sell_volume, 6) AS trade_sell_volume, round(last_trade_price, 6) AS last_trade_price, round(trade_vwap, 6) AS trade_vwap FROM g LEFT JOIN b USING (bucket_us)",
    "msg_bucket_agg": f"""WITH {EV}, m AS (SELECT event_id, ts_us - ts_us % 3600000000 AS bucket_us, user_id % 2 = 0 AS bid, CASE WHEN k >= 10 THEN k END AS q, value AS price FROM ev),
b AS (SELECT bucket_us, count(q) AS msg_count, count(*) FILTER (WHERE bid) AS bid_msg_count, count(*) FILTER (WHERE NOT bid) AS ask_msg_count, sum(q) AS total_quantity, sum(q) FILTER (WHERE bid) AS bid_quantity,
  sum(q) FILTER (WHERE NOT bid) AS ask_quantity, arg_max(price, event_id) AS last_trade_price, sum(price * q) / sum(q) AS trade_vwap FROM m GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(bucket_us) FROM b), (SELECT max(bucket_us) FROM b), 3600000000)) AS bucket_us)
SELECT bucket_us, coalesce(msg_count, 0) AS msg_count, coalesce(bid_msg_count, 0) AS bid_msg_count, coalesce(ask_msg_count, 0) AS ask_msg_count, round(total_quantity, 6) AS total_quantity, round(bid_quantity, 6) AS bid_quantity, round(ask_quantity, 6) AS ask_quantity,
round(last_trade_price, 6) AS last_trade_price, round(trade_vwap, 6) AS trade_vwap FROM g LEFT JOIN b USING (bucket_us)""",
    "trade_scrub": f"WITH {SCRUB} SELECT event_id, round(price, 6) AS price, quantity, corrected FROM s",
    "trade_scrub_stats": f"WITH {SCRUB} SELECT (SELECT count(*) FROM t) AS n0, (SELECT count(*) FROM t WHERE event_id % 97 = 0) AS broken, CAST((SELECT sum(corrected) FROM s) AS BIGINT) AS corrected",
    "flow_attach": f"WITH {TAPE}, {GRID_SQL}, {_asset_sql(0, 'A')}, {_asset_sql(1, 'B')} SELECT * FROM xAr JOIN xBr USING (ts_us)",
    "session_outer_join": f"WITH {TAPE}, {GRID_SQL}, {_asset_sql(0, 'A')}, {_asset_sql(1, 'B')} SELECT ts_us, A_buy AS A_trade_buy, round(xAb.px, 6) AS A_trade_px, B_buy AS B_trade_buy, round(xBb.px, 6) AS B_trade_px FROM xAb FULL OUTER JOIN xBb USING (ts_us)",
    "vwap_to_lot": f"""WITH {LADDERS}, f AS (SELECT l_orderkey, price, greatest(0.0, least(coalesce(qty, 0), 60.0 - coalesce(sum(coalesce(qty, 0)) OVER (PARTITION BY l_orderkey ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS fill FROM lad)
SELECT l_orderkey, CASE WHEN sum(fill) >= 60.0 - 1e-12 THEN round(sum(price * fill) FILTER (WHERE fill > 0) / 60.0, 6) END AS vwap, round(sum(fill), 6) AS filled, count(*) FILTER (WHERE fill > 0) AS levels_used FROM f GROUP BY 1""",
    "features_l1": f"""WITH {LADDERS}, q AS (SELECT * FROM lad WHERE qty IS NOT NULL), bb AS (SELECT l_orderkey, max(row(price, qty)) AS x FROM q WHERE flag <> 'R' GROUP BY 1), aa AS (SELECT l_orderkey, min(row(price, qty)) AS x FROM q WHERE flag = 'R' GROUP BY 1),
t AS (SELECT l_orderkey, bb.x[1] AS b, bb.x[2] AS bq, aa.x[1] AS a, aa.x[2] AS aq FROM bb JOIN aa USING (l_orderkey))
SELECT l_orderkey, round((b + a) / 2, 6) AS mid, round((b * aq + a * bq) / (bq + aq), 6) AS wmid, round((a - b) / ((b + a) / 2) * 1e4, 6) AS spread_bps FROM t""",
    "side_costs": f"""WITH {LADDERS}, a AS (SELECT l_orderkey, level, price, qty AS q, abs(price - first_value(price) OVER w) AS far, sum(qty) OVER w AS cum, first_value(qty) OVER w AS fq, first_value(price) OVER w AS p1 FROM lad WHERE qty > 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY level ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, (cum - fq) / nullif(sum(q) OVER (PARTITION BY l_orderkey) - fq, 0) AS x, far / nullif(max(far) OVER (PARTITION BY l_orderkey), 0) AS y, q * exp(-(level - 1) / 3.0) AS w FROM a),
c AS (SELECT *, sqrt(pow(x - lag(x) OVER v, 2) + pow(y - lag(y) OVER v, 2)) AS d FROM b WINDOW v AS (PARTITION BY l_orderkey ORDER BY level))
SELECT l_orderkey, round(sum(far / p1 * 1e4 * w) / sum(w), 6) AS decay_cost_bps, round(sum(d), 6) AS impact_length FROM c GROUP BY 1""",
    "order_flow_imbalance": """WITH d AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey, l_linenumber, floor(p / 10000) AS b, q AS bq, floor(p / 8000) + 1 AS a, q + 1 AS aq FROM d),
l AS (SELECT *, lag(b) OVER v AS b0, lag(bq) OVER v AS bq0, lag(a) OVER v AS a0, lag(aq) OVER v AS aq0 FROM w WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN b0 IS NOT NULL THEN round((CASE WHEN b >= b0 THEN bq ELSE 0 END - CASE WHEN b <= b0 THEN bq0 ELSE 0 END) - (CASE WHEN a <= a0 THEN aq ELSE 0 END - CASE WHEN a >= a0 THEN aq0 ELSE 0 END), 6) END AS ofi FROM l""",
    "third_friday": f"WITH d AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders) SELECT y, m, CAST({_EXPIRY.format(y='y', m='m')} AS VARCHAR) AS third_friday FROM d",
    "front_month": f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT d, year(d) + a AS y, code, m FROM d, (VALUES (0), (1)) t(a), (VALUES {_CONTRACTS}) u(code, m)),
e AS (SELECT *, {_EXPIRY.format(y='y', m='m')} AS expiry FROM c) SELECT CAST(d AS VARCHAR) AS d, 'ES' || arg_min(code, expiry) || (arg_min(y, expiry) % 10) AS contract, CAST(min(expiry) AS VARCHAR) AS expiry FROM e WHERE d <= expiry - 8 GROUP BY 1""",
    "type_inventory": f"WITH {MSGS} SELECT message_type, count(*) AS n FROM msgs GROUP BY 1",
    "feed_matrix": f"WITH {MSGS} SELECT f, " + ", ".join(f"count(*) FILTER (WHERE message_type = '{t}') AS {t}" for t in ("mt_add_order", "mt_cancel_order", "mt_trade", "mt_modify_order", "mt_price_level_update")) + " FROM msgs GROUP BY 1",
    "field_health": f"WITH {MSGS} SELECT f, count(*) AS n, round(avg(CAST(side IN ('Bid', 'Ask') AS INT)), 6) AS side_ok, round(avg(CAST(price IS NULL AS INT)), 6) AS bad_price, round(avg(CAST(qty IS NULL OR qty < 0 AS INT)), 6) AS bad_qty, round(avg(CAST(ref IS NULL AS INT)), 6) AS no_ref, round(median(price), 6) AS median_price FROM msgs GROUP BY 1",
    "side_tokens": f"WITH {MSGS}, c AS (SELECT f, side, count(*) AS n FROM msgs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, side) AS rank FROM c) SELECT * FROM r WHERE rank <= 4",
    "seq_continuity": f"WITH {MSGS} SELECT f, max(seq) - min(seq) + 1 AS span, count(DISTINCT seq) AS present, round(1 - count(DISTINCT seq) / (max(seq) - min(seq) + 1), 6) AS missing FROM msgs WHERE seq IS NOT NULL GROUP BY 1",
    "clock_inversions": f"WITH {MSGS}, d AS (SELECT f, ts_ns - lag(ts_ns) OVER (PARTITION BY message_type, f ORDER BY seq, arrival) AS d FROM msgs WHERE seq IS NOT NULL) SELECT f, count(d) AS pairs, count(*) FILTER (WHERE d < 0) AS inversions FROM d GROUP BY 1",
    "clock_health": f"WITH {MSGS} SELECT f, count(*) AS n, count(*) FILTER (WHERE ts_ns IS NULL) AS null_clock, count(*) FILTER (WHERE ts_ns < {LO_NS} OR ts_ns > {HI_NS}) AS off_session, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM msgs GROUP BY 1",
    "event_order": f"WITH {BOOK} SELECT event_id, f, eff_ts // 1000 AS eff_ts_us, row_number() OVER (PARTITION BY f ORDER BY ts_ns, event_id) AS clock_rank FROM o",
    "lob_levels": f"WITH {LEVELS} SELECT f, side, price, event_id, sub, round(level, 6) AS level FROM lv",
    "lob_ladder": f"WITH {SPANS} SELECT gi, side, level, price, round(qty, 6) AS qty FROM lad WHERE level <= 5",
    "lob_nbbo": f"WITH {SPANS} SELECT gi, max(price) FILTER (WHERE side = 'Bid') AS nbbo_bid, min(price) FILTER (WHERE side = 'Ask') AS nbbo_ask FROM cell WHERE qty >= 60 GROUP BY 1",
    "lob_wide": f"""WITH {SPANS}, nb AS (SELECT gi, max(price) FILTER (WHERE side = 'Bid') AS X_nbbo_bid, min(price) FILTER (WHERE side = 'Ask') AS X_nbbo_ask FROM cell WHERE qty >= 60 GROUP BY 1), p AS (SELECT gi, max(price) FILTER (WHERE side = 'Bid' AND level = 1) AS b1, max(qty) FILTER (WHERE side = 'Bid' AND level = 1) AS bq1,
max(price) FILTER (WHERE side = 'Ask' AND level = 1) AS a1, max(price) FILTER (WHERE side = 'Ask' AND level = 2) AS a2, max(qty) FILTER (WHERE side = 'Ask' AND level = 2) AS aq2 FROM lad GROUP BY 1), g AS (SELECT i AS gi FROM range({POINTS}) t(i))
SELECT {G0_US} + gi * 3600000000 AS ts_us, b1 AS X_bidprice_1, round(coalesce(bq1, 0), 6) AS X_bidquantity_1, a2 AS X_askprice_2, round(coalesce(aq2, 0), 6) AS X_askquantity_2, (b1 + a1) / 2 AS X_mid, X_nbbo_bid, X_nbbo_ask FROM g LEFT JOIN p USING (gi) LEFT JOIN nb USING (gi)""",
    "lob_crossed_rate": f"WITH {TOP} SELECT CAST({POINTS} AS BIGINT) AS points, count(*) FILTER (WHERE bid1 > ask1 + 1e-9) AS crossed, count(*) FILTER (WHERE bid1 >= ask1 - 1e-9) AS locked_or_crossed, round(count(*) FILTER (WHERE bid1 > ask1 + 1e-9) / {POINTS}.0, 6) AS rate FROM top",
    "resting_orders": f"WITH {LIFE}, e AS (SELECT f, key, arg_max(row(after, gside, gprice), (event_id, sub)) AS x FROM life GROUP BY 1, 2) SELECT f, CAST(key AS VARCHAR) AS ref, x[2] AS side, x[3] AS price, round(x[1], 6) AS size FROM e WHERE x[1] > 0",
    "orphan_provenance": f"WITH {LIFE}, a AS (SELECT DISTINCT f, ref FROM o WHERE code = 'ADD') SELECT event_id, f, code, CAST(key AS VARCHAR) AS ref, CAST(EXISTS (SELECT 1 FROM a WHERE a.f = life.f AND a.ref = life.key) AS BIGINT) AS add_present, CAST(EXISTS (SELECT 1 FROM a WHERE a.f <> life.f AND a.ref = life.key) AS BIGINT) AS on_other_feed FROM life WHERE code IN ('CANCEL', 'TRADE') AND before <= 0",
    "resurrections": f"WITH {LIFE} SELECT l.event_id, l.f, CAST(l.key AS VARCHAR) AS ref FROM life l JOIN o USING (event_id) WHERE l.code = 'MODIFY' AND l.before <= 0 AND l.killed > 0 AND (l.op = 'DEL' OR o.prev_ref = o.ref)",
    "resting_series": f"""WITH {LIFE}, m AS (SELECT greatest(0, CAST(ceil((eff_ts - {G0_US * 1000}) / 3600000000000.0) AS BIGINT)) AS gi, sum(CASE WHEN before <= 0 AND after > 0 THEN 1 WHEN before > 0 AND after <= 0 THEN -1 ELSE 0 END) AS d FROM life GROUP BY 1)
SELECT i AS gi, CAST(sum(coalesce(d, 0)) OVER (ORDER BY i) AS BIGINT) AS resting FROM range({POINTS}) t(i) LEFT JOIN m ON m.gi = i""",
    "feed_crossings": f"WITH {SPANS}, x AS (SELECT gi, f, max(price) FILTER (WHERE side = 'Bid') AS bid1, min(price) FILTER (WHERE side = 'Ask') AS ask1 FROM cell GROUP BY 1, 2) SELECT * FROM x WHERE bid1 > ask1 + 1e-9",
    "pinned_prices": f"WITH {SPANS}, x AS (SELECT gi, f, max(price) FILTER (WHERE side = 'Bid') AS bid1, min(price) FILTER (WHERE side = 'Ask') AS ask1 FROM cell GROUP BY 1, 2), y AS (SELECT f, 'Bid' AS side, bid1 AS price FROM x WHERE bid1 > ask1 + 1e-9 UNION ALL SELECT f, 'Ask', ask1 FROM x WHERE bid1 > ask1 + 1e-9) SELECT f, side, price, count(*) AS snapshots FROM y GROUP BY 1, 2, 3",
    "wrong_side": f"""WITH {LIFE}, e AS (SELECT f, key, arg_max(row(after, gside, gprice), (event_id, sub)) AS x FROM life GROUP BY 1, 2), r AS (SELECT f, key, x[2] AS side, x[3] AS price, x[1] AS size FROM e WHERE x[1] > 0),
t AS (SELECT f, max(price) FILTER (WHERE side = 'Bid') AS b, min(price) FILTER (WHERE side = 'Ask') AS a FROM r GROUP BY 1) SELECT f, CAST(key AS VARCHAR) AS ref, side, price, round(size, 6) AS size FROM r JOIN t USING (f) WHERE b > a + 1e-9 AND ((side = 'Bid' AND price > a + 1e-9) OR (side = 'Ask' AND price < b - 1e-9))""",
    "snapshot_validate": f"""WITH {TOP}, q AS (SELECT gi, max(price) FILTER (WHERE side = 'Bid' AND level = 2) AS bid2, max(price) FILTER (WHERE side = 'Ask' AND level = 2) AS ask2 FROM lad GROUP BY 1),
w AS (SELECT *, (bid1 + ask1) / 2 AS mid, {G0_US // HOUR_US} + gi AS h FROM top JOIN q USING (gi) WHERE ({G0_US // HOUR_US} + gi) % 10 <> 0),
x AS (SELECT 'X_bidprice_1' AS field, bid1 AS a, bid1 + CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END AS b FROM w UNION ALL SELECT 'X_askprice_1', ask1, ask1 FROM w UNION ALL SELECT 'X_mid', mid, mid FROM w UNION ALL SELECT 'X_bidprice_2', bid2, bid2 FROM w UNION ALL SELECT 'X_askprice_2', ask2, ask2 FROM w)
SELECT field, count(*) AS n, round(avg(CAST(abs(a - b) <= 1e-6 * greatest(1, abs(b)) AS INT)), 6) AS match_rate, round(avg(abs(a - b)), 6) AS mean_abs_diff FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
}
ORACLES["resting_sextiles"] = f"WITH r AS ({ORACLES['resting_series']}) SELECT CASE " + " ".join(f"WHEN gi < {(k + 1) * POINTS // 6} THEN {k}" for k in range(5)) + " ELSE 5 END AS sextile, round(avg(resting), 6) AS mean FROM r GROUP BY 1"

ORACLES["lob_stats"] = f"""WITH {LIFE}, c AS (SELECT count(*) AS events, count(*) FILTER (WHERE code = 'ADD') AS n_add, count(*) FILTER (WHERE code = 'CANCEL') AS n_cancel, count(*) FILTER (WHERE code = 'MODIFY') AS n_modify, count(*) FILTER (WHERE code = 'TRADE') AS n_trade,
  count(*) FILTER (WHERE code = 'LEVEL_SET') AS n_level_set, count(*) FILTER (WHERE code = 'LEVEL_DEL') AS n_level_del, count(*) FILTER (WHERE code = 'MODIFY' AND NOT maintain) AS modify_reprioritized, count(*) FILTER (WHERE f = 'LVL') AS mbp_level_events FROM o),
mv AS (SELECT event_id FROM life WHERE code = 'MODIFY' AND op = 'DEL' AND before > 0)
SELECT c.*, (SELECT count(*) FROM life WHERE op = 'SET' AND before > 0 AND (code = 'ADD' OR event_id IN (SELECT event_id FROM mv))) AS dup_add, (SELECT count(*) FROM life WHERE code = 'CANCEL' AND before <= 0) AS cancel_no_order,
  CAST(0 AS BIGINT) AS trade_on_mbp_skipped, (SELECT count(*) FROM life WHERE code = 'TRADE' AND before <= 0) AS trade_no_ref FROM c"""

_CLOCKED = TOP.replace("o AS (SELECT *, max(ts_ns) OVER (PARTITION BY f ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff_ts FROM be)", "o AS (SELECT * REPLACE (row_number() OVER (ORDER BY ts_ns, event_id) AS event_id), ts_ns AS eff_ts FROM be)")
_RATE = f"SELECT round(count(*) FILTER (WHERE bid1 > ask1 + 1e-9) / {POINTS}.0, 6) AS rate FROM top"
ORACLES["ordering_ab"] = f"SELECT a.rate AS clock_rate, b.rate AS sequence_rate FROM (WITH {_CLOCKED} {_RATE}) a, (WITH {TOP} {_RATE}) b"


def _found(kind: str, severity: str, check: str, subject: str, value: str, message: str, rows: str) -> str:
    return f"SELECT '{kind}' AS kind, {severity} AS severity, '{check}' AS \"check\", {subject} AS subject, round(CAST({value} AS DOUBLE), 6) AS value, '{message}' AS message FROM {rows}"


_COUNTS = ", ".join(f"count(*) FILTER (WHERE message_type IN ({t})) AS {n}" for n, t in (("adds", "'mt_add_order'"), ("cancels", "'mt_cancel_order'"), ("removals", "'mt_cancel_order', 'mt_trade'"), ("levels", "'mt_price_level_update'")))
_HEALTH = "avg(CAST(side IN ('Bid', 'Ask') AS INT)) AS side_ok, avg(CAST(price IS NULL AS INT)) AS bad_price, avg(CAST(qty IS NULL OR qty < 0 AS INT)) AS bad_qty, avg(CAST(ref IS NULL AS INT)) AS no_ref, median(price) AS median_price"
_FINDINGS = f"WITH {MSGS}, i AS (SELECT {_COUNTS} FROM msgs), fm AS (SELECT f, {_COUNTS} FROM msgs GROUP BY 1), fh AS (SELECT f, count(*) AS n, {_HEALTH} FROM msgs GROUP BY 1), " + """
sp AS (SELECT max(median_price) / min(median_price) AS spread FROM fh WHERE n > 100), st AS (SELECT message_type, count(seq) AS have FROM msgs GROUP BY 1),
sq AS (SELECT sum(have) AS have, count(*) FILTER (WHERE have = 0) AS lacking, string_agg(message_type, ',' ORDER BY message_type) FILTER (WHERE have = 0) AS names FROM st),
gp AS (SELECT f, 1 - count(DISTINCT seq) / (max(seq) - min(seq) + 1) AS missing FROM msgs WHERE seq IS NOT NULL GROUP BY 1),
ck AS (SELECT f, count(*) AS n, count(*) FILTER (WHERE ts_ns IS NULL) AS nulls, (max(ts_ns) - min(ts_ns)) / 1e9 AS span FROM msgs GROUP BY 1), fd AS (""" + " UNION ALL ".join(
    _found(*x)
    for x in (
        ("DATA", "'FATAL'", "inventory", "'all'", "adds", "orders are added but never removed", "i WHERE adds > 0 AND removals = 0"),
        ("DATA", "'SEVERE'", "inventory", "'all'", "cancels / adds", "few cancels for the adds", "i WHERE adds > 0 AND removals > 0 AND cancels < 0.2 * adds"),
        ("DATA", "'FATAL'", "inventory", "'all'", "adds", "neither orders nor price levels", "i WHERE adds = 0 AND levels = 0"),
        ("DATA", "'FATAL'", "feeds", "f", "adds", "a feed adds orders but never removes any", "fm WHERE adds > 1000 AND removals = 0"),
        ("DATA", "'SEVERE'", "feeds", "f", "removals / adds", "a feed has few removals for its adds", "fm WHERE adds > 1000 AND removals > 0 AND removals < 0.2 * adds"),
        ("DATA", "CASE WHEN side_ok < 0.5 THEN 'FATAL' ELSE 'SEVERE' END", "fields", "f", "side_ok", "side tokens are not recognised", "fh WHERE side_ok < 0.99"),
        ("DATA", "'SEVERE'", "fields", "f", "bad_price", "prices are missing", "fh WHERE bad_price > 0.01"),
        ("DATA", "'SEVERE'", "fields", "f", "bad_qty", "quantities are missing or negative", "fh WHERE bad_qty > 0.01"),
        ("DATA", "'SEVERE'", "fields", "f", "no_ref", "references are missing", "fh WHERE no_ref > 0.01"),
        ("DATA", "'SEVERE'", "fields", "'all'", "spread", "feeds price on different scales", "sp WHERE spread > 5"),
        ("CODE", "'FATAL'", "sequence", "'sequencenumber'", "have", "no row has a sequencenumber: venues'' own order is lost", "sq WHERE have = 0"),
        ("CODE", "'SEVERE'", "sequence", "names", "lacking", "some message types lack sequencenumber", "sq WHERE have > 0 AND lacking > 0"),
        ("DATA", "CASE WHEN missing >= 0.2 THEN 'FATAL' ELSE 'SEVERE' END", "sequence", "f", "missing", "sequence numbers are missing", "gp WHERE missing > 0.02"),
        ("CODE", "'FATAL'", "clock", "f", "nulls", "rows without a clock", "ck WHERE nulls > 0"),
        ("DATA", "'FATAL'", "clock", "f", "span", "the clock stands still", "ck WHERE n > 1000 AND span < 60"),
    )
) + ")"
ORACLES["frame_findings"] = f"{_FINDINGS} SELECT * FROM fd"
ORACLES["verdict"] = f"""{_FINDINGS}, v AS (SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'DATA' AND severity <> 'MINOR') AS data, count(*) FILTER (WHERE kind = 'CODE' AND severity <> 'MINOR') AS code FROM fd)
SELECT CASE WHEN n = 0 THEN 'NONE' WHEN data > code THEN 'DATA' WHEN code > data THEN 'CODE' ELSE 'MIXED' END AS verdict, CAST(CASE WHEN n = 0 THEN 0 WHEN data > code THEN 2 ELSE 3 END AS BIGINT) AS rc, data, code FROM v"""

_REPLAY_RULES = (
    ("DATA", "'SEVERE'", "orphans", "'all'", "other", "removals name orders of another feed", "orp WHERE other > 0"),
    ("DATA", "'MINOR'", "orphans", "'all'", "absent / removals", "a few removals without any add", "orp WHERE absent > 0 AND early <= 0.8 * absent AND absent / removals < 0.01"),
    ("DATA", "'SEVERE'", "orphans", "'all'", "absent / removals", "removals without any add", "orp WHERE absent > 0 AND early <= 0.8 * absent AND absent / removals >= 0.01"),
    ("CODE", "CASE WHEN present / (present + absent) > 0.25 THEN 'FATAL' ELSE 'SEVERE' END", "orphans", "'all'", "present / (present + absent)", "removals of orders whose add is in the log: the order of events is wrong", "orp WHERE present / (present + absent) > 0.05"),
    ("CODE", "'FATAL'", "resurrections", "'all'", "revived", "orders come back after their removal: events are replayed out of order", "dyn WHERE revived > 0"),
    ("DATA", "'SEVERE'", "dynamics", "'all'", "growth", "resting orders grow: removals are missing", "dyn WHERE growth > 5"),
    ("CODE", "'SEVERE'", "dynamics", "'all'", "early", "crossed from the start while the book does not grow", "dyn WHERE early > 0.5 AND growth < 2"),
    ("DATA", "'SEVERE'", "venues", "'all'", "rate", "the consolidated book is crossed, no venue''s own is", "dyn WHERE rate > 0.01 AND feed_rate < 0.1 * rate"),
    ("CODE", "'SEVERE'", "venues", "'all'", "feed_rate", "venues'' own books are crossed", "dyn WHERE rate > 0.01 AND feed_rate > 0.5 * rate AND growth <= 2"),
    ("CODE", "'SEVERE'", "wrong_side", "'all'", "wrong", "orders rest on the wrong side at the close", "dyn WHERE wrong > 0 AND growth < 2 AND revived = 0"),
)
_OPENING = max(60, POINTS // 100)
ORACLES["replay_findings"] = f"""WITH {TOP}, ad AS (SELECT DISTINCT f, ref FROM o WHERE code = 'ADD'),
orx AS (SELECT l.ts_ns, EXISTS (SELECT 1 FROM ad WHERE ad.f = l.f AND ad.ref = l.key) AS here, EXISTS (SELECT 1 FROM ad WHERE ad.f <> l.f AND ad.ref = l.key) AS there FROM life l WHERE l.code IN ('CANCEL', 'TRADE') AND l.before <= 0),
orp AS (SELECT (SELECT count(*) FROM o WHERE code IN ('CANCEL', 'TRADE')) AS removals, count(*) FILTER (WHERE here) AS present, count(*) FILTER (WHERE NOT here) AS absent, count(*) FILTER (WHERE NOT here AND there) AS other, count(*) FILTER (WHERE NOT here AND ts_ns <= {G0_US * 1000} + 300000000000) AS early FROM orx),
rst AS ({ORACLES["resting_series"].removeprefix(f"WITH {LIFE}, m AS ").join(["WITH m AS ", ""])}),
xf AS (SELECT gi, f, max(price) FILTER (WHERE side = 'Bid') AS b, min(price) FILTER (WHERE side = 'Ask') AS a FROM cell GROUP BY 1, 2),
wrg AS ({ORACLES["wrong_side"].removeprefix(f"WITH {LIFE}, ").join(["WITH ", ""])}),
rev AS ({ORACLES["resurrections"].removeprefix(f"WITH {LIFE} ")}),
dyn AS (SELECT (SELECT max(resting) + 1 FROM rst) / (SELECT avg(resting) + 1 FROM rst WHERE gi < {_OPENING}) AS growth, (SELECT count(*) FROM top WHERE gi < {_OPENING} AND bid1 > ask1 + 1e-9) / {_OPENING}.0 AS early,
  (SELECT count(*) FROM top WHERE bid1 > ask1 + 1e-9) / {POINTS}.0 AS rate, (SELECT count(DISTINCT gi) FROM xf WHERE b > a + 1e-9) / {POINTS}.0 AS feed_rate, (SELECT count(*) FROM wrg) AS wrong, (SELECT count(*) FROM rev) AS revived)
""" + " UNION ALL ".join(_found(*rule) for rule in _REPLAY_RULES)
