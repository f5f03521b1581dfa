"""Registered queries of the lake, the live book, as-of joins, bitmaps, sketches and counters, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave import log_queries as logs
from tickweave.functions import calendar
from tickweave.operators import asof, book, checks, coverage, price_discovery, sketches, trades

from tickweave.queries import EV, HOUR_US, LEVELS, MSGS, book_events, events, msgs, r6
from tickweave.schemas import EVENTS
from tickweave.sources import lake as lakes
from tickweave.sources import messages as src
from tickweave.staging import new_path, staged
from tickweave.streaming.live import live_levels

ORACLES: dict[str, str] = {}

LAKE_DAYS, LAKE_TYPES = ["20240105", "20240109"], ["mt_add_order", "mt_trade", "mt_price_level_update"]


def landed(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """events as logs of a product a side and day, landed twice: (the lake, files taken each time)."""
    root, lake = new_path(spark, "log"), new_path(spark, "lake")
    day = F.date_format(F.timestamp_micros("ts_us"), "yyyyMMdd")
    rows = logs.numbered(spark, sf_dir).withColumn("folder", F.concat(day, F.when(F.col("user_id") % 2 == 0, "/EVEN").otherwise("/ODD")))
    days = [r[0] for r in rows.select(day.alias("d")).distinct().collect()]  # of a month
    logs.write_logs(rows, root, [f"{d}/{p}" for d in days for p in ("EVEN", "ODD")])
    return lake, [sum(p["numInputRows"] for p in lakes.land(spark, root, lake, f"{lake}-taken")) for _ in range(2)]


def lake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days and three types of the lake: only their partitions are read. A second landing takes no file."""
    lake, taken = landed(spark, sf_dir)
    got = lakes.read(spark, lake, LAKE_DAYS, types=LAKE_TYPES)
    return got.groupBy("session_date", "product", "message_type").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.count("sequencenumber").alias("with_seq"), F.max("ts_ns").alias("last_ns")).withColumn("taken_again", F.lit(taken[1]).cast("long"))


_DAY_SQL = "strftime(make_timestamp(ts_us), '%Y%m%d')"
ORACLES["lake_counts"] = f"""WITH {logs._RAW} SELECT {_DAY_SQL} AS session_date, CASE WHEN user_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS product, kind AS message_type, count(*) AS n, sum(quantity) AS quantity, count(seq) AS with_seq, max(ts_ns) AS last_ns, CAST(0 AS BIGINT) AS taken_again
FROM lg JOIN ev USING (event_id) WHERE {_DAY_SQL} IN ('20240105', '20240109') AND kind IN ('mt_add_order', 'mt_trade', 'mt_price_level_update') GROUP BY 1, 2, 3"""


def absent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the expected (date, product, type) the lake has not."""
    lake, _ = landed(spark, sf_dir)
    expected = [(d, p, t) for d in ("20240105", "20240230") for p in ("EVEN", "NONE") for t in ("mt_trade", "mt_trade_break")]
    return lakes.failures(spark, lake, expected)


ORACLES["absent_types"] = f"""WITH {logs._RAW}, t AS (SELECT DISTINCT {_DAY_SQL} AS session_date, CASE WHEN user_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS product, kind AS message_type FROM lg JOIN ev USING (event_id)),
x AS (SELECT * FROM (VALUES ('20240105'), ('20240230')) a(session_date), (VALUES ('EVEN'), ('NONE')) b(product), (VALUES ('mt_trade'), ('mt_trade_break')) c(message_type)) SELECT x.*, 'no rows' AS reason FROM x ANTI JOIN t USING (session_date, product, message_type)"""


def saved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written to a cache and read back: rows by type, and whether they are the same rows."""
    got = logs.read_log(spark, sf_dir)
    src.save(got, path := new_path(spark, "saved"))
    back = src.load(spark, path).select(got.columns)
    sums = lambda df, n: df.groupBy("message_type").agg(F.count("*").alias(n), F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)")).alias(f"{n}_sum"))
    both = sums(got, "n").join(sums(back, "m"), "message_type", "full_outer")
    return both.select("message_type", "n", (F.col("n").eqNullSafe(F.col("m")) & F.col("n_sum").eqNullSafe(F.col("m_sum"))).alias("same"))


ORACLES["saved_messages"] = f"WITH {logs._RAW} SELECT kind AS message_type, count(*) AS n, true AS same FROM lg GROUP BY 1"


def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live book over a file stream in two runs, the second from the first one's checkpoint; the last level of each event at a price."""
    place = new_path(spark, "stream")
    every = book_events(spark, sf_dir).select([F.col(f.name).cast(f.dataType) for f in EVENTS.fields])
    middle = every.agg(((F.min("arrival") + F.max("arrival")) / 2).alias("m"), F.max("ts_ns").alias("end")).first()
    # The second run's events may lie further back than three hours (times that start anew): the book waits for them.
    second = F.col("arrival") >= middle["m"]
    back = every.agg((F.max(F.when(~second, F.col("ts_ns"))) - F.min(F.when(second, F.col("ts_ns")))).alias("ns")).first()["ns"]
    late_s = max(3 * 3600, (back or 0) // 10**9 + 2)
    end = spark.range(1).select(*[F.lit("END" if f.name == "code" else "F0" if f.name == "f" else middle["end"] + (40 * 24 * 3600 + late_s) * 10**9 if f.name == "ts_ns" else None).cast(f.dataType).alias(f.name) for f in EVENTS.fields])
    for part in (every.where(~second), every.where(second).unionByName(end)):
        part.write.mode("append").parquet(f"{place}/in")
        stream = live_levels(spark.readStream.schema(EVENTS).parquet(f"{place}/in"), HOUR_US // 1000, f"{late_s} seconds")
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{place}/out")
    return got.select("kind", "f", "side", "price", F.col("arrival").alias("event_id"), "eff_ts", (r6(F.col("level")) + 0.0).alias("level")).distinct()


ORACLES["stream_levels"] = f"WITH {LEVELS} SELECT 'level' AS kind, f, side, price, event_id, any_value(eff_ts) AS eff_ts, round(arg_max(level, sub), 6) + 0.0 AS level FROM lv GROUP BY 1, 2, 3, 4, 5"

MINUTE_US, FAR = 60_000_000, 240


def trades_and_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases and views of two assets, at minutes."""
    e = events(spark, sf_dir).select("event_id", (F.col("user_id") % 2).cast("int").alias("asset"), F.expr(f"ts_us div {MINUTE_US}").alias("minute"), F.col("value").alias("price"), "event_type")
    return e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").withColumn("quote_id", F.col("event_id")).withColumnRenamed("price", "quote").drop("event_type", "event_id")


def asof_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade with the last quote of its asset at or before it, not older than four hours, and with the next one strictly after it."""
    left, right = trades_and_quotes(spark, sf_dir)
    day = 24 * 60
    last = asof.asof_join(left, right, ["asset"], "minute", ["quote", "quote_id"], "quote_id", day, FAR, prefix="last_")
    both = asof.asof_join(last, right, ["asset"], "minute", ["quote_id"], "quote_id", day, exact=False, forward=True, prefix="next_")
    return both.select("event_id", "asset", "last_quote_id", r6(F.col("last_quote")).alias("last_quote"), (F.col("minute") - F.col("last_at")).alias("age"), r6(F.col("price") - F.col("last_quote")).alias("over_quote"), "next_quote_id", (F.col("next_at") - F.col("minute")).alias("until_next"))


ORACLES["asof_quotes"] = f"""WITH {EV}, e AS (SELECT event_id, CAST(user_id % 2 AS INTEGER) AS asset, ts_us // {MINUTE_US} AS minute, value AS price, event_type FROM ev),
t AS (SELECT * FROM e WHERE event_type = 'purchase'), q AS (SELECT asset, minute, arg_max(price, event_id) AS quote, max(event_id) AS quote_id, min(event_id) AS first_id FROM e WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT t.*, q.minute AS at, CASE WHEN t.minute - q.minute <= {FAR} THEN q.quote END AS quote, CASE WHEN t.minute - q.minute <= {FAR} THEN q.quote_id END AS quote_id, CASE WHEN t.minute - q.minute <= {FAR} THEN t.minute - q.minute END AS age FROM t ASOF LEFT JOIN q ON t.asset = q.asset AND t.minute >= q.minute)
SELECT b.event_id, b.asset, b.quote_id AS last_quote_id, round(b.quote, 6) AS last_quote, b.age, round(b.price - b.quote, 6) AS over_quote, q.first_id AS next_quote_id, q.minute - b.minute AS until_next FROM b ASOF LEFT JOIN q ON b.asset = q.asset AND b.minute < q.minute"""


def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gaps(msgs(spark, sf_dir))


ORACLES["seq_gaps"] = f"""WITH {MSGS}, s AS (SELECT DISTINCT f, seq FROM msgs WHERE seq IS NOT NULL), p AS (SELECT f, seq, lag(seq) OVER (PARTITION BY f ORDER BY seq) AS was FROM s)
SELECT f, was + 1 AS first, seq - 1 AS last, seq - was - 1 AS n FROM p WHERE seq - was > 1"""


def seq_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity by feed, from bitmaps by feed and type that are merged."""
    got = coverage.continuity(coverage.merged(coverage.bitmaps(msgs(spark, sf_dir), ["f", "message_type"])))
    return got.select("f", "span", "present", r6(F.col("missing")).alias("missing"))


ORACLES["seq_bitmaps"] = f"WITH {MSGS} SELECT f, max(seq) - min(seq) + 1 AS span, count(DISTINCT seq) AS present, round(1 - count(DISTINCT seq) / (max(seq) - min(seq) + 1), 6) AS missing FROM msgs WHERE seq IS NOT NULL GROUP BY 1"


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 9th deciles by feed from sketches by feed and type: is their true rank within the stated error?"""
    rows = msgs(spark, sf_dir)
    by_feed = staged(sketches.merged(sketches.sketched(rows, ["f", "message_type"]), ["f"]), "sketches")
    out = None
    for q in (0.5, 0.9):
        answers = by_feed.withColumn("answer", sketches.quantile(q))
        one = sketches.rank_errors(rows, answers, ["f"], q).select("f", F.lit(q).alias("q"), "n", (F.col("error") <= sketches.RANK_ERROR).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


ORACLES["price_quantiles"] = f"WITH {MSGS} SELECT f, CAST(q AS DOUBLE) AS q, count(price) AS n, true AS within FROM msgs, (VALUES (0.5), (0.9)) t(q) GROUP BY 1, 2"


def scrub_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scrub of trades does, counted while they pass (one scan of the tape)."""
    tape = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("value").alias("price"), F.col("k").alias("quantity"), F.col("event_id").alias("matchid"))
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    breaks = e.where("event_id % 97 = 0").select(F.col("event_id").alias("matchid"))
    corrections = e.where("event_id % 89 = 0").select(F.col("event_id").alias("matchid"), (F.col("value") + 1).alias("newprice"), F.lit(None).cast("double").alias("newquantity"), F.col("event_id").alias("arrival"))
    clean, counters = trades.scrub_counted(tape, breaks, corrections)
    rows = staged(clean, "scrubbed").count()
    return spark.createDataFrame([(*[counters.get[c] for c in ("n0", "broken", "corrected", "no_price")], rows)], "n0 long, broken long, corrected long, no_price long, left long")


ORACLES["scrub_counters"] = f"WITH {EV} SELECT count(*) AS n0, count(*) FILTER (WHERE event_id % 97 = 0) AS broken, count(*) FILTER (WHERE event_id % 89 = 0 AND event_id % 97 <> 0) AS corrected, count(*) FILTER (WHERE value IS NULL) AS no_price, count(*) FILTER (WHERE event_id % 97 <> 0) AS \"left\" FROM ev WHERE event_type = 'purchase'"


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a clock, feed, sequence or reference, and rejected adds, counted while the events are written."""
    seen, counters = book.counted(src.replay_events(logs.read_log(spark, sf_dir)))
    staged(seen, "events")
    names = ["rows", "no_clock", "no_feed", "no_seq", "no_ref", "rejected_adds"]
    return spark.createDataFrame([tuple(counters.get[c] for c in names)], ", ".join(f"{c} long" for c in names))


ORACLES["event_counters"] = f"""WITH {logs._RAW} SELECT count(*) AS rows, count(*) FILTER (WHERE ts_ns IS NULL) AS no_clock, count(*) FILTER (WHERE f IS NULL) AS no_feed, count(*) FILTER (WHERE seq IS NULL) AS no_seq, count(*) FILTER (WHERE code NOT LIKE 'LEVEL%' AND ref IS NULL) AS no_ref,
  count(*) FILTER (WHERE code = 'ADD' AND NOT coalesce(price IS NOT NULL AND qty > 0 AND side IN ('Bid', 'Ask'), false)) AS rejected_adds FROM lg"""


def message_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = checks.message_cube(msgs(spark, sf_dir), F.expr(f"pmod(ts_ns div {HOUR_US * 1000}L, 24)").cast("long"))
    return got.withColumn("volume", r6(F.col("volume")))


ORACLES["message_cube"] = f"""WITH {MSGS}, h AS (SELECT *, (ts_ns // {HOUR_US * 1000}) % 24 AS hour FROM msgs)
SELECT f, message_type, hour, CASE grouping(f, message_type, hour) WHEN 0 THEN 'feed,type,hour' WHEN 1 THEN 'feed,type' WHEN 3 THEN 'feed' WHEN 5 THEN 'type' ELSE 'all' END AS level, count(*) AS n, count(price) AS with_price, round(sum(qty), 6) AS volume
FROM h GROUP BY GROUPING SETS ((f, message_type, hour), (f, message_type), (f), (message_type), ())"""

LAGS = 2


def price_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of an error correction model of two prices (in hundredths): lineitem's dearest and second line by order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("a"), F.min("l_extendedprice").alias("b"))
    cents = lambda c: F.round(F.col(c)).cast("long")
    got = price_discovery.gram(price_discovery.lagged(li.select(F.col("l_orderkey").alias("n"), cents("a").alias("x"), cents("b").alias("y")), LAGS), price_discovery.columns(LAGS))
    return got.withColumn("total", F.col("total").cast("long"))


_NAMES = price_discovery.columns(LAGS)
ORACLES["price_gram"] = "WITH p AS (SELECT l_orderkey AS n, CAST(round(max(l_extendedprice)) AS BIGINT) AS x, CAST(round(min(l_extendedprice)) AS BIGINT) AS y FROM lineitem GROUP BY 1), v AS (SELECT p0.n, 1 AS one, p1.x - p1.y AS z, " + ", ".join(f"p{k}.{v} - p{k + 1}.{v} AS d{v}_{k}" for k in range(1, LAGS + 1) for v in "xy") + ", p0.x - p1.x AS dx, p0.y - p1.y AS dy FROM p p0 " + " ".join(f"JOIN p p{k} ON p{k}.n = p0.n - {k}" for k in range(1, LAGS + 2)) + ") " + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, CAST(sum({a} * {b}) AS BIGINT) AS total FROM v" for k, a in enumerate(_NAMES) for b in _NAMES[k:])


def flow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which assets' trade flow a session frame has (all its columns), and the trades in it."""
    frame = staged(logs.session_frame(spark, sf_dir), "frame")
    rows = [(a, trades.has_trade_flow(frame.columns, [a])) for a in ("aaa", "bb", "zz")]
    sums = frame.agg(*[F.sum(F.col(f"{a}_trade_buy") + F.col(f"{a}_trade_sell")).alias(a) for a in ("aaa", "bb")])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.col(a).alias("n")) for a in ("aaa", "bb")])).alias("x")).select("x.*")
    return spark.createDataFrame(rows, "asset string, has_flow boolean").join(long, "asset", "left").fillna(0, ["n"])


ORACLES["flow_columns"] = f"WITH s AS ({logs.ORACLES['session_frame']}) SELECT a AS asset, a <> 'zz' AS has_flow, CAST(coalesce(CASE a WHEN 'aaa' THEN (SELECT sum(aaa_trade_buy + aaa_trade_sell) FROM s) WHEN 'bb' THEN (SELECT sum(bb_trade_buy + bb_trade_sell) FROM s) END, 0) AS BIGINT) AS n FROM (VALUES ('aaa'), ('bb'), ('zz')) t(a)"

ROOTS = ["es", "MNQ", "RTY", "M2K", "SPY"]


def contract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as contracts of a few roots: trades, point value, and their worth in money, by root."""
    root = F.element_at(F.array(*map(F.lit, ROOTS)), (F.col("user_id") % len(ROOTS) + 1).cast("int"))
    t = events(spark, sf_dir).where("event_type = 'purchase'").select(root.alias("root"), F.col("value").alias("price"), "k")
    worth = F.sum(F.round(calendar.notional(F.col("root"), F.col("price"), F.col("k")) * 100).cast("long"))
    return t.groupBy("root", calendar.point_value(F.col("root")).alias("point_value")).agg(F.count("*").alias("n"), worth.alias("cents"))


ORACLES["contract_values"] = f"""WITH {EV}, t AS (SELECT ['es', 'MNQ', 'RTY', 'M2K', 'SPY'][user_id % 5 + 1] AS root, value, k FROM ev WHERE event_type = 'purchase'),
m AS (SELECT *, CAST(CASE upper(root) WHEN 'ES' THEN 50 WHEN 'MNQ' THEN 2 WHEN 'RTY' THEN 50 WHEN 'M2K' THEN 5 END AS DOUBLE) AS point_value FROM t)
SELECT root, point_value, count(*) AS n, CAST(sum(CAST(round(value * k * coalesce(point_value, 1.0) * 100) AS BIGINT)) AS BIGINT) AS cents FROM m GROUP BY 1, 2"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        contract_values, lake_counts, absent_types, saved_messages, stream_levels, asof_quotes, seq_gaps, seq_bitmaps, price_quantiles, scrub_counters, event_counters, message_cube, price_gram, flow_columns,
    )
}
