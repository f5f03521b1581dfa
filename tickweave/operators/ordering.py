"""The order of events: by each venue's own sequence, venues merged by clock.

Adds to EVENTS:
``k1``, ``k2``  the order within a feed is (k1, k2, arrival);
``eff_ts``      when an event becomes visible: the feed's running greatest clock
                in sequence order, else its own clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.blocks import running_max, tasks_for

REMOVALS = ["CANCEL", "TRADE", "LEVEL_DEL"]
LAST = (1 << 63) - 1
ORDER = ["k1", "k2", "arrival"]
#: Sequence numbers in one block of the running maximum.
BLOCK = 1_000_000


def block_of(block: int = BLOCK) -> Column:
    """The block of an ordered row: rows of one block follow one another in the order of a feed."""
    last = F.col("k1") == LAST
    return F.struct(F.floor(F.col("k1") / block).cast("long").alias("a"), F.when(last, F.col("k2")).otherwise(F.lit(0)).cast("long").alias("b"), F.when(last, F.floor(F.col("arrival") / block).cast("long")).otherwise(F.lit(0)).cast("long").alias("c"))


def ordered_events(events: DataFrame, order_by: str = "sequence", parity: bool = False, block: int = BLOCK) -> DataFrame:
    """EVENTS with k1, k2, eff_ts.

    order_by "sequence": by (sequence, removals last, arrival), missing sequences
    last; a feed without any sequence goes by (clock, removals last, arrival). With
    ``parity`` that holds only if no feed has one. Anything else: by (clock, arrival).
    """
    elim = F.col("code").isin(REMOVALS).cast("long")
    if order_by != "sequence":
        return events.withColumns({"k1": F.col("ts_ns"), "k2": F.lit(0).cast("long"), "eff_ts": F.col("ts_ns")})
    has = events.groupBy("f").agg((F.count("seq") > 0).alias("_has"))
    if parity:
        some = has.agg(F.coalesce(F.max("_has"), F.lit(False)).alias("_any"))
        has = has.join(F.broadcast(some)).select("f", F.col("_any").alias("_has"))  # one row
    marked = events.join(F.broadcast(has), "f")  # a row a feed: events of a feed do not meet in one task
    keyed = marked.withColumns({"k1": F.when(F.col("_has"), F.coalesce("seq", F.lit(LAST))).otherwise(F.col("ts_ns")), "k2": elim})
    # Blocks grow with the order; rows without a sequence, the last of their feed, are cut by arrival.
    late = F.col("seq").isNull()
    at = F.when(late, F.lit(LAST)).otherwise(F.floor(F.col("seq") / block).cast("long"))
    zero = F.lit(0).cast("long")
    keyed = keyed.withColumn("_block", F.struct(at.alias("a"), F.when(late, F.col("k2")).otherwise(zero).alias("b"), F.when(late, F.floor(F.col("arrival") / block).cast("long")).otherwise(zero).alias("c")))
    degraded = keyed.where(~F.col("_has")).withColumn("eff_ts", F.col("ts_ns"))
    running = running_max(keyed.where("_has"), "ts_ns", ORDER, "_block", "eff_ts", ["f"], tasks_for(events))
    return running.unionByName(degraded).drop("_block", "_has")


def coverage(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by,) rows, rows with a sequence, and the warning that ordering is only partial."""
    got = events.groupBy(*by).agg(F.count("*").alias("rows"), F.count("seq").alias("with_seq"))
    share = F.col("with_seq") / F.col("rows")
    return got.withColumn("warning", F.when(F.col("with_seq") == 0, "ORDERING DEGRADED").when(share < 0.999, "ORDERING PARTIAL"))
