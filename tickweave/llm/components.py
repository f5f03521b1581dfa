"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Parts into which the links of one node are dealt, so that a hub is not one task's.
SALTS = 16


def _hooked(links: DataFrame) -> DataFrame:
    """links(u, v) with m, the least of u and its v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _hooked(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links(u, v) -> u, root: each node that is not the least of its component, with that least node.

    Each round is two pre-aggregated minima and joins on the node, written to the
    shared folder; nothing but three sums comes to the driver. Raises if the rounds
    do not suffice (they halve the depth).
    """
    now = staged(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = staged(_small(_large(now)), "links")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if mark == seen or not mark[0]:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
