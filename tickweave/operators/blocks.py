"""Running functions over one long order, without one long task.

The order is cut into blocks (a function of its leading key, such as the hour).
Rows are windowed within blocks; what a block hands on is one summary row, and
only the summaries (one a block) are windowed together. All functions of one
order share the summaries, so the rows are read twice however many there are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Events in one task of a sort or window, about.
ROWS = 150_000


def tasks_for(df: DataFrame) -> int:
    """Tasks that share out the work on df (of which this asks the number of rows, in a short job if df is staged): what one holds does not grow with df."""
    spark = df.sparkSession
    return max(ceil(df.count() / ROWS), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_back(df: DataFrame, keys: list[str], block: str, before: DataFrame) -> DataFrame:
    """df with the other columns of before(keys, block), one row a block."""
    match = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*keys, block]]
    return df.alias("_l").join(before.alias("_r"), match, "left").select("_l.*", *[f"_r.{c}" for c in before.columns if c not in (*keys, block)])


def before_blocks(df: DataFrame, keys: list[str], block: str, handed: dict[str, tuple[Column, object]]) -> DataFrame:
    """A row a block with a column for each of ``handed``: name -> (what a block hands on, an aggregate; how earlier blocks' values run together)."""
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy(*keys, block).agg(*[one.alias(name) for name, (one, _) in handed.items()])
    return each.select(*keys, block, *[running(F.col(name)).over(w).alias(name) for name, (_, running) in handed.items()])


def with_before(df: DataFrame, keys: list[str], block: str, handed: dict[str, tuple[Column, object]]) -> DataFrame:
    """df with the columns of before_blocks()."""
    return join_back(df, keys, block, before_blocks(df, keys, block, handed))


def last_value(value: str, order: list[str]) -> Column:
    """A block's last value that is not null."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value]


def latest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def in_block(keys: list[str], block: str, order: list):
    return Window.partitionBy(*keys, block).orderBy(*order)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def carried(df: DataFrame, values: list[str], order: list[str], block: str, keys: list[str] = ()) -> DataFrame:
    """Adds for each value v ``v_filled`` (the last one that is not null, up to and with the row) and ``v_was`` (the same of the row before)."""
    keys = list(keys)
    w = in_block(keys, block, order)
    got = with_before(df, keys, block, {f"_{v}": (last_value(v, order), latest) for v in values})
    got = got.withColumns({f"{v}_filled": F.coalesce(latest(F.col(v)).over(upto(w)), F.col(f"_{v}")) for v in values})
    was = {f"{v}_was": F.when(F.row_number().over(w) == 1, F.col(f"_{v}")).otherwise(F.lag(f"{v}_filled").over(w)) for v in values}
    return got.withColumns(was).drop(*[f"_{v}" for v in values])


def previous(df: DataFrame, value: str, order: list[str], block: str, out: str, keys: list[str] = ()) -> DataFrame:
    """Adds ``out``: value of the row before (null for the first)."""
    keys = list(keys)
    w = in_block(keys, block, order)
    got = with_before(df, keys, block, {"_before": (F.max(F.struct(*order, value)), F.last)})
    return got.withColumn(out, F.when(F.row_number().over(w) == 1, F.col(f"_before.{value}")).otherwise(F.lag(value).over(w))).drop("_before")


def ranked(df: DataFrame, order: list[str], block: str, out: str, keys: list[str] = ()) -> DataFrame:
    """Adds ``out``: the number of the row, from 1."""
    keys = list(keys)
    got = with_before(df, keys, block, {"_before": (F.count("*"), F.sum)})
    return got.withColumn(out, F.row_number().over(in_block(keys, block, order)) + F.coalesce("_before", F.lit(0))).drop("_before")


def ticks(df: DataFrame, price: str, order: list[str], block: str, out: str, keys: list[str] = ()) -> DataFrame:
    """Adds ``out``: the sign of the last change of price from one row to the next (a null price is no change), null before any."""
    keys = list(keys)
    w, blocks = in_block(keys, block, order), Window.partitionBy(*keys).orderBy(block)
    change = lambda a, b: F.nullif(F.signum(a - b), F.lit(0.0))
    own = df.withColumns({"_nth": F.row_number().over(w), "_step": change(F.col(price), F.lag(price).over(w))})
    end = F.struct(*order, price)
    each = own.groupBy(*keys, block).agg(F.min(end)[price].alias("_a"), F.max(end)[price].alias("_b"), last_value("_step", order).alias("_s"))
    each = each.withColumn("_last", F.lag("_b").over(blocks))
    each = each.withColumn("_s", F.coalesce("_s", change(F.col("_a"), F.col("_last"))))
    each = each.select(*keys, block, "_last", latest(F.col("_s")).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    got = join_back(own, keys, block, each)
    step = F.when(F.col("_nth") == 1, change(F.col(price), F.col("_last"))).otherwise(F.col("_step"))
    return got.withColumn("_step", step).withColumn(out, F.coalesce(latest(F.col("_step")).over(upto(w)), F.col("_before"))).drop("_nth", "_step", "_last", "_before")


def running_max(df: DataFrame, value: str, order: list, block: str, out: str, keys: list[str], tasks: int) -> DataFrame:
    """Adds ``out``: the greatest value up to and with the row. keys and block are never null; rows are dealt out and sorted once, in ``tasks``."""
    own = df.repartition(tasks, *keys, block).withColumn(out, F.max(value).over(upto(in_block(keys, block, order))))
    before = before_blocks(df, keys, block, {"_before": (F.max(value), F.max)})
    return own.join(before.hint("shuffle_hash"), [*keys, block], "left").withColumn(out, F.greatest(out, "_before")).drop("_before")


def bounded_sum(df: DataFrame, add: Column, floor: Column, reset: Column, carry: Column, order: list[str], block: str, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: a sum over the order that starts at 0, where each row is ``v -> floor`` if ``reset``, else ``v -> greatest(v + add, floor)`` (a null floor: no bound).

    Also ``<out>_before`` (0 for the first row) and ``carry_before``: of the row before, the sum and ``carry``.
    Such functions are closed under composition (max and plus are), so a block hands on
    one of them. Within a stretch since the last reset the sum is S + M: S the
    running sum of ``add``, M the running greatest of ``floor - S``.
    """
    keys, zero = list(keys), F.lit(0.0)
    w = in_block(keys, block, order)
    got = df.withColumns({"_add": F.when(reset, zero).otherwise(add), "_floor": floor, "_reset": reset.cast("int"), "_carry": carry})
    got = got.withColumn("_cut", F.sum("_reset").over(upto(w)))
    stretch = upto(Window.partitionBy(*keys, block, "_cut").orderBy(*order))
    got = got.withColumn("_s", F.sum("_add").over(stretch)).withColumn("_m", F.max(F.col("_floor") - F.col("_s")).over(stretch))
    # What a block does to the value before it: v -> greatest(v + s, s + m), or s + m after a reset.
    end = got.groupBy(*keys, block).agg(F.max_by(F.struct("_cut", "_s", "_m", "_carry"), F.struct(*order)).alias("e"))
    end = end.select(*keys, block, (F.col("e._cut") > 0).alias("_any"), F.col("e._s").alias("_bs"), (F.col("e._s") + F.col("e._m")).alias("_bm"), F.col("e._carry").alias("_end"))
    over = Window.partitionBy(*keys).orderBy(block)
    end = end.withColumn("_cut", F.sum(F.col("_any").cast("int")).over(upto(over)))
    ws = upto(Window.partitionBy(*keys, "_cut").orderBy(block))
    end = end.withColumn("_t", F.sum(F.when(F.col("_any"), zero).otherwise(F.col("_bs"))).over(ws)).withColumn("_u", F.max(F.col("_bm") - F.col("_t")).over(ws))
    end = end.withColumn("_after", F.col("_t") + F.greatest("_u", F.when(F.col("_cut") == 0, zero)))
    before = end.select(*keys, block, F.coalesce(F.lag("_after").over(over), zero).alias("_start"), F.lag("_end").over(over).alias("_had"))
    back = join_back(got, keys, block, before).withColumn(out, F.col("_s") + F.greatest("_m", F.when(F.col("_cut") == 0, F.col("_start"))))
    first = F.row_number().over(w) == 1
    back = back.withColumns({f"{out}_before": F.when(first, F.col("_start")).otherwise(F.lag(out).over(w)), "carry_before": F.when(first, F.col("_had")).otherwise(F.lag("_carry").over(w))})
    return back.drop("_add", "_floor", "_reset", "_carry", "_cut", "_s", "_m", "_start", "_had")
