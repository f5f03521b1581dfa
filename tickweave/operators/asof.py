"""As-of join on event time: to each left row the last right row at or before it.

Both streams are put into one order and cut into blocks of time; a block hands on its
last right row, and rows are windowed within blocks. So neither a busy key nor a long
quiet one is a single task, and nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.blocks import in_block, last_value, latest, upto, with_before


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tie: str, block: int, tolerance: int | None = None, exact: bool = True, forward: bool = False, prefix: str = "") -> DataFrame:
    """left with ``values`` (and ``ts`` as ``<prefix>at``) of the right row that holds at its time.

    keys: equal on both sides (null equals null). ``ts`` is an integer on both sides; ``tie`` (a number) orders right rows of one time (the
    last one counts; with ``forward`` the first). ``exact``: whether a right row of the same time counts. ``tolerance``: the
    greatest distance in time; beyond it, or without any right row, the values are null. ``forward``: the
    next right row instead of the last one. ``block``: units of time windowed together. A left row without a time matches nothing.
    """
    sign = F.lit(-1 if forward else 1)
    kinds = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    quote = F.struct(F.col(ts).alias("at"), *[F.col(v) for v in values])
    empty = F.lit(None).cast(f"struct<at:{kinds[ts]},{','.join(f'`{v}`:{kinds[v]}' for v in values)}>")
    # A left row stands behind the right rows of its time if they count, else before them.
    mine = left.where(F.col(ts).isNotNull()).select(*keys, F.struct(*left.columns).alias("_row"), (F.col(ts) * sign).alias("_t"), F.lit(2 if exact else 0).alias("_kind"), F.lit(None).cast(kinds[tie]).alias("_tie"), empty.alias("_quote"), F.lit(True).alias("_left"))
    theirs = right.where(F.col(ts).isNotNull()).select(*keys, F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), (F.col(ts) * sign).alias("_t"), F.lit(1).alias("_kind"), (F.col(tie) * sign).alias("_tie"), quote.alias("_quote"), F.lit(False).alias("_left"))
    order = ["_t", "_kind", "_tie"]
    every = mine.unionByName(theirs).withColumn("_block", F.floor(F.col("_t") / block))
    got = with_before(every, keys, "_block", {"_before": (last_value("_quote", order), latest)})
    w = upto(in_block(keys, "_block", order))
    out = got.withColumn("_held", F.coalesce(latest(F.col("_quote")).over(w), F.col("_before"))).where("_left")
    near = F.col("_held") if tolerance is None else F.when((F.col("_t") - F.col("_held.at") * sign) <= tolerance, F.col("_held"))
    out = out.withColumn("_held", near)
    cells = [F.col("_held.at").alias(f"{prefix}at"), *[F.col(f"_held.{v}").alias(f"{prefix}{v}") for v in values]]
    matched = out.select("_row.*", *cells)
    timeless = left.where(F.col(ts).isNull()).select("*", *[F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in matched.columns[len(left.columns) :]])
    return matched.unionByName(timeless)
