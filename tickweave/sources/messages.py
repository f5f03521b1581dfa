"""Message logs from files: typed, with one clock and an arrival number.

A log is a folder ``<root>/<date>/<product>/<message type>`` of CSV (or Parquet)
files. The header names the columns; those that the engine knows get their types, and
Catalyst prunes what a query does not use. A type that cannot be read is an error unless ``on_missing`` is
"empty"; then it is listed in the failures.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.schemas import CLOCKS, DOUBLE_COLUMNS, LONG_COLUMNS, MESSAGE_TYPES, NULL_TOKENS, STRING_COLUMNS
from tickweave.staging import staged

#: Bytes up to which a list of files' pieces is broadcast.
SMALL = 16 << 20
KNOWN = [*LONG_COLUMNS, *STRING_COLUMNS, *DOUBLE_COLUMNS]


def number(c: Column) -> Column:
    """A number, else null; NaN and infinities are null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def token(c: Column) -> Column:
    """A trimmed string; the tokens that stand for a missing value are null."""
    s = F.trim(c.cast("string"))
    return F.when(~s.isin(NULL_TOKENS), s)


def typed(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The known columns with their types, nulls where absent; of other columns only ``keep`` stay."""
    kinds = {**dict.fromkeys(LONG_COLUMNS, "bigint"), **dict.fromkeys(STRING_COLUMNS, "string"), **dict.fromkeys(DOUBLE_COLUMNS, "double")}
    out = []
    for name, kind in kinds.items():
        if name not in raw.columns:
            c = F.lit(None).cast(kind)
        elif kind == "bigint":  # straight to an integer: a double loses digits beyond 2 ** 53
            s = F.col(name).cast("string")
            c = F.coalesce(s.try_cast("bigint"), number(F.col(name)).cast("bigint"))
        else:
            c = token(F.col(name)) if kind == "string" else number(F.col(name))
        out.append(c.alias(name))
    return raw.select(*out, *keep)


def read_type(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One message type's files. The order of files by name, and of rows within them, becomes ``arrival``."""
    if fmt == "csv":
        # Every column as a string: a schema is applied by position, so the header decides here.
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    at = typed(raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")), ["_file", "_start", "_id"])
    # Text is read once: the rows are kept in columns before their pieces are ranked.
    return ranked(staged(at, "read") if fmt == "csv" else at, [])


def ranked(at: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_place`` in place of _file, _start, _id: the rank (within ``keys``) of a row's piece of file, by name, then offset, then the row within it.

    Spark packs pieces into tasks by their sizes, so the number that it gives a row
    orders the rows of one piece only. The pieces (one row each) are ranked together;
    they are broadcast if they are few, which is asked for.
    """
    pieces = at.select(*keys, "_file", "_start").distinct()
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("_file") + 64), F.lit(0))).first()[0]
    by = Window.partitionBy(*keys).orderBy("_file", "_start")
    rank = pieces.withColumn("_rank", F.row_number().over(by).cast("long"))
    place = F.shiftleft(F.col("_rank"), 33) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(rank) if size <= SMALL else rank, [*keys, "_file", "_start"]).withColumn("_place", place).drop("_file", "_start", "_rank", "_id")


def absent(error: Exception) -> bool:
    """Whether an error says that a path does not exist."""
    return getattr(error, "getCondition", lambda: None)() == "PATH_NOT_FOUND"


def messages(spark: SparkSession, root: str, date: str, product: str, types: list[str] | None = None, clock: str = "receipt", fmt: str = "csv", on_missing: str = "fail") -> tuple[DataFrame, dict[str, str]]:
    """(messages with message_type, ts_ns, arrival; failures by type) of one session."""
    frames, failures = [], {}
    for name in types or list(MESSAGE_TYPES):
        if name not in MESSAGE_TYPES:
            raise ValueError(f"unknown message type {name!r}")
        try:
            frame = read_type(spark, f"{root}/{date}/{product}/{name}", fmt)
        except AnalysisException as error:
            if on_missing != "empty" or not absent(error):  # only what does not exist is taken for empty
                raise
            failures[name] = str(error).splitlines()[0]
            continue
        frames.append(frame.withColumn("message_type", F.lit(name)))
    if not frames:  # all are missing, and that was asked for
        frames = [typed(spark.createDataFrame([], message_schema())).withColumn("_place", F.lit(0).cast("long")).withColumn("message_type", F.lit(None).cast("string"))]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return clocked(out, clock), failures


def clocked(df: DataFrame, clock: str = "receipt") -> DataFrame:
    """Adds ts_ns (nanoseconds, the truth for ordering), ts (microseconds) and arrival."""
    ts = F.coalesce(*[F.col(c) for c in CLOCKS[clock]], F.col("receipttimestamp"))
    rank = F.element_at(F.create_map(*[x for k, v in MESSAGE_TYPES.items() for x in (F.lit(k), F.lit(v[0]))]), F.col("message_type"))
    arrival = (rank.cast("long") * F.lit(1 << 58)) + F.col("_place")
    return df.withColumn("ts_ns", ts).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withColumn("arrival", arrival).drop("_place")


def quantity(message_type: Column) -> Column:
    """The quantity of a row, from the column that its type uses."""
    out = F.lit(None).cast("double")
    for name, (_, _, column) in MESSAGE_TYPES.items():
        out = F.when(message_type == name, F.col(column)).otherwise(out)
    return out


def in_session(df: DataFrame, date: str, start: str, end: str, tz: str = "America/New_York") -> DataFrame:
    """Rows whose local time is in the session, both ends included."""
    edge = lambda t: F.unix_micros(F.to_utc_timestamp(F.lit(f"{date[:4]}-{date[4:6]}-{date[6:]} {t}:00"), tz)) * 1000
    return df.where((F.col("ts_ns") >= edge(start)) & (F.col("ts_ns") <= edge(end)))


def replay_events(msgs: DataFrame, price_scale: float | Column = 1.0) -> DataFrame:
    """The rows of EVENTS of typed messages; an admin delete sets its level to 0, a missing previous reference is the own one."""
    code = F.lit(None).cast("string")
    for name, (_, c, _) in MESSAGE_TYPES.items():
        code = F.when(F.col("message_type") == name, F.lit(c).cast("string")).otherwise(code)
    qty = F.when((code == "LEVEL_SET") & (F.lower("admindelete") == "true"), F.lit(0.0)).when(code == "CANCEL", F.col("previousquantity")).otherwise(F.col("quantity"))
    return msgs.select(
        "f", code.alias("code"), "side", (F.col("price") * F.lit(price_scale)).alias("price"), qty.alias("qty"),
        F.col("orderreferencenumber").alias("ref"), F.coalesce("previousorderreferencenumber", "orderreferencenumber").alias("prev_ref"),
        F.coalesce(F.lower("maintainpriority") != "false", F.lit(True)).alias("maintain"), F.col("sequencenumber").alias("seq"), "ts_ns", "arrival",
    ).where("code is not null")


SNAPSHOT_FIELD = r"^(bid|ask|bsize|asize)(\d+)$"


def canonical_field(field: str, root: str) -> str | None:
    """The canonical name of a vendor snapshot field, or None."""
    import re

    if field == "mid":
        return f"{root}_mid"
    found = re.match(SNAPSHOT_FIELD, field)
    if not found:
        return None
    side = "bid" if found[1].startswith("b") else "ask"
    return f"{root}_{side}{'quantity' if found[1].endswith('size') else 'price'}_{int(found[2])}"


def snapshot(spark: SparkSession, path: str, prefix: str, root: str, levels: int, price_scale: float = 1.0, tz: str = "America/New_York", integrity: bool = True) -> DataFrame:
    """A vendor book snapshot (CSV with local times) as the canonical wide book."""
    raw = spark.read.option("header", True).csv(path)
    clock = next((c for c in ("time", "datetime") if c in raw.columns), None)
    fields = {c: canonical_field(c[len(prefix) + 1 :], root) for c in raw.columns if c.startswith(f"{prefix}.")}
    names = {c: n for c, n in fields.items() if n}
    if clock is None or f"{root}_bidprice_1" not in names.values():
        raise ValueError("no time column or no first level in the snapshot")
    scaled = lambda c, n: number(F.col(f"`{c}`")) * (price_scale if "price" in n or n.endswith("_mid") else 1.0)
    wide = raw.select(F.to_utc_timestamp(F.col(clock).cast("timestamp_ntz").cast("string"), tz).alias("ts"), *[scaled(c, n).alias(n) for c, n in names.items()])
    return (whole_levels(wide, root, levels) if integrity else wide).orderBy("ts")


def whole_levels(wide: DataFrame, root: str, levels: int) -> DataFrame:
    """A level with a missing price or quantity is missing whole."""
    new = {}
    for side in ("bid", "ask"):
        for k in range(1, levels + 1):
            p, q = f"{root}_{side}price_{k}", f"{root}_{side}quantity_{k}"
            if p in wide.columns and q in wide.columns:
                ok = finite(F.col(p)) & finite(F.col(q))
                new |= {p: F.when(ok, F.col(p)), q: F.when(ok, F.col(q))}
    return wide.withColumns(new) if new else wide


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def save(df: DataFrame, path: str) -> None:
    """Keep messages for later runs, by type."""
    df.write.mode("overwrite").partitionBy("message_type").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def message_schema() -> T.StructType:
    """The typed message row."""
    kinds = {**dict.fromkeys(LONG_COLUMNS, T.LongType()), **dict.fromkeys(STRING_COLUMNS, T.StringType()), **dict.fromkeys(DOUBLE_COLUMNS, T.DoubleType())}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
