"""Registered queries that go through message logs: events are written as CSV logs and read back.

The raw columns of a log are stated once (LOG), as expressions that Spark and DuckDB
both read. The logs have what real ones have: padded and unknown tokens, missing
values by several names, a venue without sequence numbers, one with both orders and
price levels, invalid adds, modifies that name two orders, trades without an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions import calendar, features
from tickweave.operators import book, checks, ladder, replay_checks
from tickweave.operators.ordering import ordered_events
from tickweave.plans import sessions
from tickweave.queries import EV, G0_US, GRID_SQL, HOUR_US, LADDERS, ORACLES as BASE, POINTS, SPANS, events, ladders, ordered_book, r6, spans
from tickweave.sources import messages as src
from tickweave.staging import new_path, staged

TYPES = ["mt_add_order", "mt_cancel_order", "mt_modify_order", "mt_trade", "mt_price_level_update", "mt_delete_price_level"]
_KIND = "CASE event_type WHEN 'signup' THEN 'mt_add_order' WHEN 'error' THEN 'mt_cancel_order' WHEN 'click' THEN 'mt_modify_order' WHEN 'purchase' THEN 'mt_trade' ELSE CASE WHEN k % 7 < 5 THEN 'mt_price_level_update' ELSE 'mt_delete_price_level' END END"
_TEXT = "CAST({} AS STRING)"
#: Raw column -> expression over event_id, ts_us, user_id, event_type, value, k (an integer).
LOG = {
    "receipttimestamp": _TEXT.format("(ts_us - (event_id * 37 % 11) * 1000000000) * 1000 + event_id % 1000"),
    "exchangetimestamp": "CASE WHEN event_id % 4 = 0 THEN '' ELSE " + _TEXT.format("ts_us * 1000") + " END",
    "sequencenumber": "CASE WHEN (user_id % 3 = 2 AND event_type <> 'view') OR event_id % 33 = 0 THEN '' ELSE " + _TEXT.format("event_id") + " END",
    "f": "CASE WHEN event_type = 'view' AND user_id % 9 > 0 THEN 'LVL' ELSE 'F' || " + _TEXT.format("user_id % 3") + " END",
    "side": "CASE WHEN user_id % 2 = 0 THEN ' Bid' WHEN k % 25 = 7 THEN '?' ELSE 'Ask ' END",
    "price": "CASE WHEN k % 50 = 13 THEN 'NaN' ELSE " + _TEXT.format("CAST(round(value) AS BIGINT) + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 4 END") + " END",
    "quantity": "CASE WHEN event_type = 'signup' AND k % 23 = 0 THEN '-1' WHEN event_type = 'click' AND k % 10 = 9 THEN '0' ELSE " + _TEXT.format("k + 1") + " END",
    "previousquantity": _TEXT.format("k + 2"),
    "orderreferencenumber": "CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'null' WHEN (event_type = 'click' AND k % 10 = 9) OR (event_type = 'signup' AND k % 6 = 0) THEN 'X' || " + _TEXT.format("user_id % 50") + " WHEN event_type = 'click' AND k % 5 = 0 THEN " + _TEXT.format("user_id + 3") + " ELSE " + _TEXT.format("user_id") + " END",
    "previousorderreferencenumber": "CASE WHEN event_type = 'click' AND (k % 10 = 9 OR k % 5 = 0) THEN " + _TEXT.format("user_id") + " ELSE '' END",
    "maintainpriority": "CASE WHEN k % 2 = 0 THEN ' FALSE' ELSE '' END",
    "admindelete": "CASE WHEN k % 4 = 0 THEN 'True' ELSE 'false' END",
    "tradereferencenumber": _TEXT.format("event_id"),
    "notes": "'unknown column'",
}
DATE, PRODUCT = "20240101", "LOG"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("k", F.col("k").cast("long"))


def write_logs(df: DataFrame, root: str, folders: list[str]) -> None:
    """Rows of numbered() with ``folder`` as CSV files in the order of event_id: <root>/<folder>/<type>, all in one job.

    A partitioned write asks for rows sorted by its columns. The sort here begins with the
    one that there is, never null or constant; else Spark would sort by it once more,
    and that loses the order of event_id as soon as it spills.
    """
    raw = df.withColumn("at", F.concat_ws("/", "folder", F.expr(_KIND))).repartitionByRange("at", "event_id").sortWithinPartitions("at", "event_id")
    raw.selectExpr("at", *[f"{e} AS {n}" for n, e in LOG.items()]).write.partitionBy("at").option("header", True).csv(f"{root}/parts")
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        for kind in TYPES:
            made = path(f"{root}/parts/at={folder.replace('/', '%2F')}%2F{kind}")
            if fs.exists(made):
                fs.mkdirs(path(f"{root}/{folder}"))
                fs.rename(made, path(f"{root}/{folder}/{kind}"))


def read_log(spark: SparkSession, sf_dir: str, clock: str = "receipt") -> DataFrame:
    root = new_path(spark, "log")
    write_logs(numbered(spark, sf_dir).withColumn("folder", F.lit(f"{DATE}/{PRODUCT}")), root, [f"{DATE}/{PRODUCT}"])
    return src.messages(spark, root, DATE, PRODUCT, [*TYPES, "mt_trade_break"], clock, on_missing="empty")[0]


def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_log(spark, sf_dir, "exchange")
    return got.select(
        F.col("tradereferencenumber").alias("event_id"), "message_type", "f", "side", "price", src.quantity(F.col("message_type")).alias("qty"), F.col("orderreferencenumber").alias("ref"),
        F.col("sequencenumber").alias("seq"), "ts_ns", F.unix_micros("ts").alias("ts_us"), F.col("oldprice").isNull().alias("no_oldprice"),
    )


def log_replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_log(spark, sf_dir)
    rank = F.expr("arrival div 288230376151711744")
    return src.replay_events(got.withColumn("f", F.concat_ws(":", "f", "tradereferencenumber")), 0.01).select(
        F.col("f").alias("feed_event"), "code", "side", r6(F.col("price")).alias("price"), "qty", "ref", "prev_ref", "maintain", "seq", "ts_ns", rank.alias("type_rank")
    )


def log_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(ordered_events(staged(src.replay_events(read_log(spark, sf_dir)), "events")), "ordered")


def logged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = log_ordered(spark, sf_dir)
    return book.levels(ordered, staged(book.lifecycle(ordered), "lifecycle"))


def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logged_levels(spark, sf_dir)
    return got.groupBy("f", "side", "price", "eff_ts").agg(F.count("*").alias("changes"), r6(F.sum(F.greatest("level", F.lit(0.0)))).alias("sum_of_levels"))


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.replay_stats(log_ordered(spark, sf_dir))


def dual_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.dual_feeds(log_ordered(spark, sf_dir))


def level_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds whose book has any level at the end: of orders or of price levels."""
    return logged_levels(spark, sf_dir).where("level > 1e-9").select("f").distinct()


def log_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.in_session(read_log(spark, sf_dir), "20240103", "09:30", "16:00").groupBy("message_type").agg(F.count("*").alias("n"))


_NUMBER = "CAST(nullif({}, 'NaN') AS DOUBLE)"
_RAW = EV.replace("CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)") + f""", raw AS (SELECT event_id, {_KIND} AS kind, {", ".join(f"{e} AS {n}" for n, e in LOG.items())} FROM ev),
lg AS (SELECT event_id, kind, f, trim(side) AS side, {_NUMBER.format("price")} AS price, CAST(quantity AS DOUBLE) AS quantity, CAST(previousquantity AS DOUBLE) AS previousquantity, nullif(orderreferencenumber, 'null') AS ref,
  coalesce(nullif(previousorderreferencenumber, ''), nullif(orderreferencenumber, 'null')) AS prev_ref, lower(trim(maintainpriority)) <> 'false' AS maintain, CAST(nullif(sequencenumber, '') AS BIGINT) AS seq,
  CAST(receipttimestamp AS BIGINT) AS ts_ns, coalesce(CAST(nullif(exchangetimestamp, '') AS BIGINT), CAST(receipttimestamp AS BIGINT)) AS exchange_ns,
  CASE WHEN kind = 'mt_price_level_update' AND lower(admindelete) = 'true' THEN 0.0 WHEN kind = 'mt_cancel_order' THEN CAST(previousquantity AS DOUBLE) ELSE CAST(quantity AS DOUBLE) END AS qty,
  CASE kind WHEN 'mt_add_order' THEN 0 WHEN 'mt_cancel_order' THEN 1 WHEN 'mt_modify_order' THEN 2 WHEN 'mt_trade' THEN 3 WHEN 'mt_price_level_update' THEN 4 ELSE 6 END AS type_rank,
  CASE kind WHEN 'mt_add_order' THEN 'ADD' WHEN 'mt_cancel_order' THEN 'CANCEL' WHEN 'mt_modify_order' THEN 'MODIFY' WHEN 'mt_trade' THEN 'TRADE' WHEN 'mt_price_level_update' THEN 'LEVEL_SET' ELSE 'LEVEL_DEL' END AS code FROM raw)"""

#: From lg (one row an event) to every change of a level: lc(f, side, price, ord, sub, eff_ts, event_id, level).
_REPLAY = """, hs AS (SELECT f, count(seq) > 0 AS has FROM lg GROUP BY 1),
ok AS (SELECT lg.*, has, CASE WHEN has THEN coalesce(seq, 9223372036854775807) ELSE ts_ns END AS k1, CASE WHEN code IN ('CANCEL', 'TRADE', 'LEVEL_DEL') THEN 1 ELSE 0 END AS k2 FROM lg JOIN hs USING (f)),
od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY f, k1, k2, type_rank, event_id) AS ord, coalesce(price IS NOT NULL AND qty > 0 AND side IN ('Bid', 'Ask'), false) AS valid,
  CASE WHEN has THEN max(ts_ns) OVER (PARTITION BY f ORDER BY k1, k2, type_rank, event_id ROWS UNBOUNDED PRECEDING) ELSE ts_ns END AS eff_ts FROM ok),
fl AS (SELECT f, min(ord) AS first_level FROM od WHERE code LIKE 'LEVEL%' GROUP BY 1),
s0 AS (SELECT f, ord, event_id, eff_ts, code, side, price, qty, ts_ns, 1 AS sub, 'SET' AS op, ref AS key FROM od WHERE code IN ('ADD', 'MODIFY') AND valid
  UNION ALL SELECT f, ord, event_id, eff_ts, code, side, price, qty, ts_ns, 0, 'DEL', ref FROM od WHERE code = 'CANCEL'
  UNION ALL SELECT f, ord, event_id, eff_ts, code, side, price, qty, ts_ns, 0, 'RED', ref FROM od WHERE code = 'TRADE'
  UNION ALL SELECT f, ord, event_id, eff_ts, code, side, price, qty, ts_ns, 0, 'DEL', prev_ref FROM od WHERE code = 'MODIFY' AND prev_ref IS DISTINCT FROM ref
  UNION ALL SELECT f, ord, event_id, eff_ts, code, side, price, qty, ts_ns, 1, 'DEL', ref FROM od WHERE code = 'MODIFY' AND prev_ref IS NOT DISTINCT FROM ref AND NOT valid),
""" + "".join(
    f"""{p}gn AS (SELECT *, sum(CASE WHEN op = 'RED' THEN 0 ELSE 1 END) OVER (PARTITION BY f, key ORDER BY ord, sub ROWS UNBOUNDED PRECEDING) AS gen FROM {p}st WHERE key IS NOT NULL),
{p}sz AS (SELECT *, first_value(CASE WHEN op = 'SET' THEN qty ELSE 0 END) OVER g AS size, first_value(CASE WHEN op = 'SET' THEN side END) OVER g AS gside, first_value(CASE WHEN op = 'SET' THEN price END) OVER g AS gprice,
  sum(CASE WHEN op = 'RED' THEN qty ELSE 0 END) OVER g AS taken FROM {p}gn WINDOW g AS (PARTITION BY f, key, gen ORDER BY ord, sub ROWS UNBOUNDED PRECEDING)),
{p}af AS (SELECT *, CASE WHEN gen > 0 AND size - taken > 1e-9 THEN size - taken ELSE 0 END AS after FROM {p}sz),
{p}life AS (SELECT *, coalesce(lag(after) OVER w, 0) AS before, lag(gside) OVER w AS was_side, lag(gprice) OVER w AS was_price FROM {p}af WINDOW w AS (PARTITION BY f, key ORDER BY ord, sub)),
"""
    + step
    # First without the steps that depend on others, to see which of those take effect; then with them.
    for p, step in (("a", "st AS (SELECT * FROM s0 UNION ALL SELECT o.f, o.ord, o.event_id, o.eff_ts, o.code, o.side, o.price, o.qty, o.ts_ns, 1, 'DEL', o.ref FROM od o WHERE o.code = 'MODIFY' AND NOT o.valid AND o.ref IS NOT NULL AND o.prev_ref IS DISTINCT FROM o.ref AND NOT EXISTS (SELECT 1 FROM alife l WHERE l.ord = o.ord AND l.sub = 0 AND l.before > 0)),\n"), ("", ""))
).replace("agn AS", "ast AS (SELECT * FROM s0), agn AS", 1) + """mv AS (SELECT f, ord, sub * 2 AS sub, event_id, eff_ts, was_side AS side, was_price AS price, CASE WHEN op = 'RED' AND after > 0 THEN after - before ELSE -before END AS delta, op <> 'RED' OR after <= 0 AS whole, 'delta' AS kind FROM life WHERE before > 0
  UNION ALL SELECT f, ord, sub * 2 + 1, event_id, eff_ts, side, price, qty, true, 'delta' FROM life WHERE op = 'SET'
  UNION ALL SELECT f, ord, 0, event_id, eff_ts, side, price, CASE WHEN code = 'LEVEL_SET' THEN qty ELSE 0 END, true, 'assign' FROM od WHERE code LIKE 'LEVEL%' AND side IN ('Bid', 'Ask') AND price IS NOT NULL
  UNION ALL SELECT o.f, o.ord, 0, o.event_id, o.eff_ts, o.side, o.price, o.qty, true, 'take' FROM od o LEFT JOIN life l ON l.ord = o.ord LEFT JOIN fl ON fl.f = o.f
    WHERE o.code = 'TRADE' AND coalesce(l.before, 0) <= 0 AND o.price IS NOT NULL AND coalesce(o.ord <= first_level, true)),
mn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY f, price ORDER BY ord, sub) AS n FROM mv),
fo AS (SELECT f, price, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS bid, CAST(NULL AS DOUBLE) AS ask, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS INTEGER) AS sub, CAST(NULL AS BIGINT) AS eff_ts, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT f, price FROM mn)
  UNION ALL SELECT f, price, n, CASE WHEN tgt = 'Bid' THEN val ELSE bid END, CASE WHEN tgt = 'Ask' THEN val ELSE ask END, tgt, ord, sub, eff_ts, event_id FROM (
    SELECT *, CASE kind WHEN 'take' THEN CASE WHEN delta < cur - 1e-9 THEN cur - delta END WHEN 'assign' THEN CASE WHEN delta > 1e-9 THEN delta END
      ELSE CASE WHEN NOT (delta < 0 AND whole AND coalesce(cur, 0) + delta <= 1e-9) THEN coalesce(cur, 0) + delta END END AS val FROM (
    SELECT *, CASE tgt WHEN 'Bid' THEN bid WHEN 'Ask' THEN ask END AS cur FROM (
    SELECT m.*, fo.bid, fo.ask, CASE WHEN m.kind <> 'take' THEN m.side WHEN fo.ask IS NOT NULL THEN 'Ask' WHEN fo.bid IS NOT NULL THEN 'Bid' END AS tgt FROM fo JOIN mn m ON m.f = fo.f AND m.price = fo.price AND m.n = fo.n + 1)))),
lc AS (SELECT f, side, price, ord, sub, eff_ts, event_id, coalesce(CASE side WHEN 'Bid' THEN bid ELSE ask END, 0) AS level FROM fo WHERE side IS NOT NULL)"""
_LOGGED = "WITH RECURSIVE " + _RAW + _REPLAY

ORACLES: dict[str, str] = {
    "log_messages": f"WITH {_RAW} SELECT event_id, kind AS message_type, f, side, price, CASE WHEN kind = 'mt_cancel_order' THEN previousquantity ELSE quantity END AS qty, ref, seq, exchange_ns AS ts_ns, exchange_ns // 1000 AS ts_us, true AS no_oldprice FROM lg",
    "log_replay_events": f"WITH {_RAW} SELECT f || ':' || event_id AS feed_event, code, side, round(price * 0.01, 6) AS price, qty, ref, prev_ref, maintain OR maintain IS NULL AS maintain, seq, ts_ns, CAST(type_rank AS BIGINT) AS type_rank FROM lg",
    "log_levels": f"{_LOGGED} SELECT f, side, price, eff_ts, count(*) AS changes, round(sum(greatest(level, 0)), 6) AS sum_of_levels FROM lc GROUP BY 1, 2, 3, 4",
    "log_stats": _LOGGED + ", tk AS (SELECT l.ord FROM life l WHERE l.code = 'MODIFY' AND l.op = 'DEL' AND l.before > 0), " + ", ".join(["rf AS (SELECT o.ord, coalesce(o.ord > first_level, false) AS shown FROM od o LEFT JOIN life l ON l.ord = o.ord LEFT JOIN fl ON fl.f = o.f WHERE o.code = 'TRADE' AND coalesce(l.before, 0) <= 0)"]) + " SELECT count(*) AS events, " + ", ".join(f"count(*) FILTER (WHERE code = '{c}') AS n_{c.lower()}" for c in ("ADD", "CANCEL", "MODIFY", "TRADE", "LEVEL_SET", "LEVEL_DEL")) + """,
  count(*) FILTER (WHERE code = 'MODIFY' AND NOT maintain) AS modify_reprioritized, count(*) FILTER (WHERE code LIKE 'LEVEL%') AS mbp_level_events,
  (SELECT count(*) FROM life WHERE op = 'SET' AND before > 0 AND (code = 'ADD' OR ord IN (SELECT ord FROM tk))) AS dup_add, count(*) FILTER (WHERE code = 'CANCEL') - (SELECT count(*) FROM life WHERE code = 'CANCEL' AND before > 0) AS cancel_no_order,
  (SELECT count(*) FROM rf WHERE shown) AS trade_on_mbp_skipped, (SELECT count(*) FROM rf WHERE NOT shown) AS trade_no_ref FROM od""",
    "dual_feeds": f"WITH {_RAW} SELECT f FROM lg WHERE code LIKE 'LEVEL%' INTERSECT SELECT f FROM lg WHERE code IN ('ADD', 'MODIFY') AND price IS NOT NULL AND qty > 0 AND side IN ('Bid', 'Ask')",
    "level_feeds": f"{_LOGGED} SELECT DISTINCT f FROM lc WHERE level > 1e-9",
    "log_in_session": f"WITH {_RAW} SELECT kind AS message_type, count(*) AS n FROM lg WHERE ts_ns BETWEEN 1704292200000000000 AND 1704315600000000000 GROUP BY 1",
}


def contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, expiries, roots and lots of the contract that is in front on each order date."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_format(F.to_date("o_orderdate"), "yyyyMMdd").alias("day")).distinct()
    front = days.withColumn("d", F.to_date("day", "yyyyMMdd")).withColumn("code", calendar.front_month(F.lit("es"), F.col("d")))
    lots = {t: F.lit(calendar.default_lot(t)) for t in ("direct", "futures")}
    return front.select("day", "code", calendar.contract_expiry(F.col("code"), F.year("d")).cast("string").alias("expiry"), calendar.futures_root(F.col("code")).alias("root"), calendar.canonical_root(F.col("code"), "direct").alias("direct_root"), lots["direct"].alias("lot"), lots["futures"].alias("futures_lot"))


_EXPIRY = "make_date(y, m, 1) + CAST((5 - isodow(make_date(y, m, 1)) + 7) % 7 + 14 AS INTEGER)"
ORACLES["contract_terms"] = f"""WITH d AS (SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS day, CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT day, d, year(d) + a AS y, code, m FROM d, (VALUES (0), (1)) t(a), (VALUES ('H', 3), ('M', 6), ('U', 9), ('Z', 12)) u(code, m)),
e AS (SELECT *, {_EXPIRY} AS expiry FROM c), g AS (SELECT day, year(any_value(d)) AS yr, 'es' || arg_min(code, expiry) || (arg_min(y, expiry) % 10) AS code, arg_min(m, expiry) AS m FROM e WHERE d <= expiry - 8 GROUP BY 1), h AS (SELECT *, yr // 10 * 10 + CAST(right(code, 1) AS INTEGER) AS y FROM g)
SELECT day, code, CAST({_EXPIRY} AS VARCHAR) AS expiry, 'ES' AS root, upper(code) AS direct_root, CAST(100 AS DOUBLE) AS lot, CAST(1 AS DOUBLE) AS futures_lot FROM h"""


def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-1 features and the depth-weighted mid on the canonical book."""
    s = spans(spark, sf_dir)
    wide = ladder.wide_book(spark, ladder.ladder(s, 2), ladder.nbbo(s), "X", 2, POINTS, G0_US, HOUR_US)
    deep = features.depth_weighted_mid([tuple(F.col(f"X_{x}_{k}") for x in ("bidprice", "bidquantity", "askprice", "askquantity")) for k in (1, 2)])
    got = features.with_features(wide, "X").withColumn("deep", deep)
    return got.select(F.unix_micros("ts").alias("ts_us"), *[r6(F.col(c)).alias(c.lower()) for c in ("X_mid", "X_wmid", "X_spread_bps", "deep")])


def scale_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two assets' first bids: the book and its prices in other units."""
    s = spans(spark, sf_dir)
    wide = ladder.wide_book(spark, ladder.ladder(s, 1), ladder.nbbo(s), "X", 1, POINTS, G0_US, HOUR_US).withColumn("Y_bidprice_1", F.col("X_bidprice_1") * 250)
    got = sessions.scale_warning(wide, "X", "Y")
    return got.select(r6(F.col("median_a")).alias("median_a"), r6(F.col("median_b")).alias("median_b"), "warning")


def oldest_wrong_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay_checks.wrong_side(ordered_book(spark, sf_dir))
    return replay_checks.oldest_wrong(found).select("f", "n", "ref", "side", "price", F.col("born").alias("born_ns"), F.col("k").cast("long").alias("k"))


def orphans_by_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_checks.orphans_by_feed(replay_checks.orphans(ordered_book(spark, sf_dir)))


_LADDER2 = """q AS (SELECT gi, max(price) FILTER (WHERE side = 'Bid' AND level = 1) AS b1, max(qty) FILTER (WHERE side = 'Bid' AND level = 1) AS bq1, max(price) FILTER (WHERE side = 'Ask' AND level = 1) AS a1, max(qty) FILTER (WHERE side = 'Ask' AND level = 1) AS aq1,
  sum(price * qty) FILTER (WHERE side = 'Bid' AND level <= 2) / sum(qty) FILTER (WHERE side = 'Bid' AND level <= 2) AS bm, sum(price * qty) FILTER (WHERE side = 'Ask' AND level <= 2) / sum(qty) FILTER (WHERE side = 'Ask' AND level <= 2) AS am FROM lad GROUP BY 1)"""
ORACLES["book_features"] = f"""WITH {SPANS}, {GRID_SQL}, {_LADDER2} SELECT g.ts_us, round((b1 + a1) / 2, 6) AS x_mid, round((b1 * aq1 + a1 * bq1) / (bq1 + aq1), 6) AS x_wmid, CASE WHEN (b1 + a1) / 2 > 1e-12 THEN round((a1 - b1) / ((b1 + a1) / 2) * 1e4, 6) END AS x_spread_bps, round((bm + am) / 2, 6) AS deep
FROM grid g LEFT JOIN q ON g.ts_us = {G0_US} + gi * 3600000000"""
ORACLES["scale_medians"] = f"WITH {SPANS}, {_LADDER2} SELECT round(median(b1), 6) AS median_a, round(median(b1 * 250), 6) AS median_b, median(b1 * 250) / median(b1) > 100 AS warning FROM q"
ORACLES["orphans_by_feed"] = f"SELECT f, count(*) AS n FROM ({BASE['orphan_provenance']}) GROUP BY 1 ORDER BY n DESC, f LIMIT 6"
ORACLES["oldest_wrong_side"] = BASE["wrong_side"].replace("SELECT f, CAST(key AS VARCHAR) AS ref, side, price, round(size, 6) AS size FROM r JOIN t", ", w AS (SELECT f, CAST(key AS VARCHAR) AS ref, key, side, price FROM r JOIN t", 1) + """), bn AS (SELECT f, key, arg_max(ts_ns, (event_id, sub)) AS born FROM life WHERE op = 'SET' GROUP BY 1, 2), n AS (SELECT f, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, f LIMIT 6),
x AS (SELECT f, n, ref, side, price, born AS born_ns, row_number() OVER (PARTITION BY f ORDER BY born NULLS LAST, ref) AS k FROM w JOIN bn USING (f, key) JOIN n USING (f)) SELECT * FROM x WHERE k <= 3"""


def finding_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their place in the report."""
    from tickweave.queries import frame_findings

    return checks.placed(frame_findings(spark, sf_dir)).select("place", "severity", "kind", "check", "subject")


ORACLES["finding_ranks"] = f"""SELECT row_number() OVER (ORDER BY CASE severity WHEN 'FATAL' THEN 1 WHEN 'SEVERE' THEN 2 ELSE 3 END, kind, "check", subject, message) AS place, severity, kind, "check", subject FROM ({BASE['frame_findings']})"""

DAYS = ["20240103", "20240104", "20240109", "20240105"]
SESSION = sessions.Window("09:30", "16:00", 600)


def session_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date of two assets (a stock and the front future), replayed, joined and with their trade flow."""
    root = new_path(spark, "sessions")
    rows = numbered(spark, sf_dir)
    folder, folders = F.lit(None).cast("string"), []
    for day in DAYS:
        midnight = sessions.micros(day, "00:00", "UTC")
        two = [f"{day}/AAA", f"{day}/{sessions.contract_of('BB', sessions.parse_date(day))}"]
        folder = F.when(F.col("ts_us").between(midnight, midnight + 24 * HOUR_US - 1), F.when(F.col("user_id") % 2 == 0, two[0]).otherwise(two[1])).otherwise(folder)
        folders += two
    write_logs(rows.withColumn("folder", folder).where("folder is not null"), root, folders)
    assets = [sessions.Asset("AAA", types=TYPES, sign="side"), sessions.Asset("BB", "futures", 0.5, TYPES[:4], "tick")]
    wide, _ = sessions.extract_sessions(spark, root, [(d, f"r{d[-1]}") for d in DAYS], assets, 1, SESSION, on_missing="empty")
    cells = [r6(F.col(f"{a}_{c}")).alias(f"{a.lower()}_{c}") for a in ("AAA", "BB") for c in ("bidprice_1", "bidquantity_1", "askprice_1", "askquantity_1", "mid", "nbbo_bid", "trade_buy", "trade_sell", "trade_px")]
    return wide.select("session_date", "regime", F.unix_micros("ts").alias("ts_us"), *cells)


_STEP = 600
_G0 = {day: sessions.micros(day, "09:30", "America/New_York") for day in DAYS}
_N = 40  # points of SESSION
_DAY = "CASE " + " ".join(f"WHEN e.ts_us // 86400000000 = {sessions.micros(d, '00:00', 'UTC') // 86_400_000_000} THEN '{d}'" for d in DAYS) + " END"
_SESSION_LOG = _RAW.replace("lg AS (", "lg0 AS (", 1) + f""", lg AS (SELECT lg0.* REPLACE (day || asset || lg0.f AS f, lg0.price * CASE WHEN asset = 'bb' THEN 0.5 ELSE 1.0 END AS price), lg0.f AS feed, day, asset, lg0.price AS raw_price FROM (SELECT lg0.*, {_DAY} AS day, CASE WHEN e.user_id % 2 = 0 THEN 'aaa' ELSE 'bb' END AS asset FROM lg0 JOIN ev e USING (event_id)) lg0
  WHERE day IS NOT NULL AND (asset = 'aaa' OR kind IN ('mt_add_order', 'mt_cancel_order', 'mt_modify_order', 'mt_trade')))"""
_SESSION = "WITH RECURSIVE " + _SESSION_LOG + _REPLAY + f""", da AS (SELECT DISTINCT f, day, asset FROM lg), dy AS (SELECT * FROM (VALUES {", ".join(f"('{d}', {_G0[d]})" for d in DAYS)}) t(day, g0)), gr AS (SELECT day, g0, i AS gi, g0 + i * {_STEP}000000 AS ts_us FROM dy, range({_N}) t(i)),
pl AS (SELECT day, asset, f, side, price, level, ord, sub, greatest(0, CAST(ceil((eff_ts - g0 * 1000) / {_STEP}000000000.0) AS BIGINT)) AS gi FROM lc JOIN da USING (f) JOIN dy USING (day)),
la AS (SELECT day, asset, f, side, price, gi, arg_max(level, (ord, sub)) AS qty FROM pl WHERE gi < {_N} GROUP BY 1, 2, 3, 4, 5, 6), iv AS (SELECT *, coalesce(lead(gi) OVER (PARTITION BY f, side, price ORDER BY gi), {_N}) AS hi FROM la),
ce AS (SELECT day, asset, f, side, price, qty, unnest(range(gi, hi)) AS gi FROM iv WHERE qty > 1e-9), ag AS (SELECT day, asset, gi, side, price, sum(qty) AS qty FROM ce GROUP BY 1, 2, 3, 4, 5),
tp AS (SELECT day, asset, gi, max(price) FILTER (WHERE side = 'Bid') AS b, arg_max(qty, price) FILTER (WHERE side = 'Bid') AS bq, min(price) FILTER (WHERE side = 'Ask') AS a, arg_min(qty, price) FILTER (WHERE side = 'Ask') AS aq FROM ag GROUP BY 1, 2, 3),
nb AS (SELECT day, asset, gi, max(price) AS n FROM ce WHERE side = 'Bid' AND qty >= CASE WHEN asset = 'bb' THEN 1 ELSE 100 END GROUP BY 1, 2, 3),
tr AS (SELECT * FROM lg JOIN dy USING (day) WHERE kind = 'mt_trade' AND ts_ns BETWEEN g0 * 1000 AND (g0 + {(_N - 1) * _STEP}000000) * 1000),
t1 AS (SELECT *, nullif(sign(raw_price - lag(raw_price) OVER w), 0) AS step FROM tr WINDOW w AS (PARTITION BY day, asset ORDER BY ts_ns, event_id)),
t2 AS (SELECT *, coalesce(CASE WHEN asset = 'aaa' AND side = 'Bid' THEN 1 WHEN asset = 'aaa' AND side = 'Ask' THEN -1 END, last_value(step IGNORE NULLS) OVER (PARTITION BY day, asset ORDER BY ts_ns, event_id ROWS UNBOUNDED PRECEDING), 0) AS sgn FROM t1),
fw AS (SELECT day, asset, g0 + (ts_ns // 1000 - g0) // {_STEP}000000 * {_STEP}000000 AS ts_us, count(*) FILTER (WHERE sgn > 0) AS buy, count(*) FILTER (WHERE sgn < 0) AS sell, arg_max(price, (ts_ns, event_id)) FILTER (WHERE price IS NOT NULL) AS px FROM t2 GROUP BY 1, 2, 3)
SELECT gr.day AS session_date, 'r' || right(gr.day, 1) AS regime, gr.ts_us, """ + ", ".join(
    f"round({x}.b, 6) AS {n}_bidprice_1, round(coalesce({x}.bq, 0), 6) AS {n}_bidquantity_1, round({x}.a, 6) AS {n}_askprice_1, round(coalesce({x}.aq, 0), 6) AS {n}_askquantity_1, round(({x}.b + {x}.a) / 2, 6) AS {n}_mid, round({x}n.n, 6) AS {n}_nbbo_bid, coalesce({x}f.buy, 0) AS {n}_trade_buy, coalesce({x}f.sell, 0) AS {n}_trade_sell, round({x}f.px, 6) AS {n}_trade_px"
    for x, n in (("p", "aaa"), ("r", "bb"))
) + " FROM gr " + " ".join(f"LEFT JOIN tp {x} ON {x}.day = gr.day AND {x}.gi = gr.gi AND {x}.asset = '{n}' LEFT JOIN nb {x}n ON {x}n.day = gr.day AND {x}n.gi = gr.gi AND {x}n.asset = '{n}' LEFT JOIN fw {x}f ON {x}f.day = gr.day AND {x}f.ts_us = gr.ts_us AND {x}f.asset = '{n}'" for x, n in (("p", "aaa"), ("r", "bb")))
ORACLES["session_frame"] = _SESSION


def snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor snapshots of two assets, written from the ladders of orders, read, made whole and outer-joined."""
    root = new_path(spark, "snapshots")
    rows = ladders(spark, sf_dir).where("level <= 2")
    time = F.date_format(F.timestamp_seconds(F.lit(1_704_292_200) + F.col("l_orderkey")), "yyyy-MM-dd HH:mm:ss").alias("time")
    for prefix, keep in (("direct", "l_orderkey % 3 <> 0"), ("futures", "l_orderkey % 3 <> 1")):
        at = lambda k, c: F.max(F.when(F.col("level") == k, F.col(c)))
        cells = [x for k in (1, 2) for x in (at(k, "price").alias(f"{prefix}.bid{k}"), at(k, "qty").alias(f"{prefix}.bsize{k}"))]
        rows.where(keep).groupBy("l_orderkey").agg(*cells).select(time, *[F.col(f"`{prefix}.{n}{k}`") for k in (1, 2) for n in ("bid", "bsize")]).write.option("header", True).csv(f"{root}/{prefix}")
    both = sessions.snapshot_pair(spark, [(f"{root}/direct", "direct", "A", 1.0), (f"{root}/futures", "futures", "B", 0.01)], 2, "UTC")
    return both.select((F.unix_seconds("ts") - 1_704_292_200).alias("l_orderkey"), *[r6(F.col(f"{a}_bid{x}_{k}")).alias(f"{a.lower()}_{x}_{k}") for a in "AB" for k in (1, 2) for x in ("price", "quantity")])


_SNAP = lambda n, keep, scale: f"{n} AS (SELECT l_orderkey, " + ", ".join(f"max(price) FILTER (WHERE level = {k} AND qty IS NOT NULL) * {scale} AS p{k}, max(qty) FILTER (WHERE level = {k}) AS q{k}" for k in (1, 2)) + f" FROM lad WHERE level <= 2 AND {keep} GROUP BY 1)"
ORACLES["snapshot_join"] = f"WITH {LADDERS}, {_SNAP('a', 'l_orderkey % 3 <> 0', 1.0)}, {_SNAP('b', 'l_orderkey % 3 <> 1', 0.01)} SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, " + ", ".join(f"round({x}.p{k}, 6) AS {x}_price_{k}, round({x}.q{k}, 6) AS {x}_quantity_{k}" for x in "ab" for k in (1, 2)) + " FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        log_messages, log_replay_events, log_levels, log_stats, dual_feeds, level_feeds, log_in_session, contract_terms, book_features, scale_medians, oldest_wrong_side, orphans_by_feed, finding_ranks, session_frame, snapshot_join,
    )
}
