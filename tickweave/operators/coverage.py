"""Which sequence numbers of a feed there are: exact, as bitmaps that can be merged.

A bitmap holds 32,768 numbers in 4 KB, whatever the number of rows; bitmaps of parts (hours, types, files)
are merged by OR. Gaps are found within buckets of the same width; a bucket hands on its last number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.blocks import previous


def bitmaps(msgs: DataFrame, by: list[str | Column] = ("f",)) -> DataFrame:
    """(by,) bucket, bits, low, high: the numbers ``seq`` that occur; rows without one are left out."""
    return msgs.where("seq is not null").groupBy(*by, F.bitmap_bucket_number("seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("bits"), F.min("seq").alias("low"), F.max("seq").alias("high"))


def merged(parts: DataFrame, by: list[str] = ("f",)) -> DataFrame:
    """Bitmaps of parts put together: (by,) bucket, bits, low, high."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"))


def continuity(bits: DataFrame, by: list[str] = ("f",)) -> DataFrame:
    """(by,) span, present (distinct numbers), missing (share)."""
    got = bits.groupBy(*by).agg((F.max("high") - F.min("low") + 1).alias("span"), F.sum(F.bitmap_count("bits")).alias("present"))
    return got.withColumn("missing", 1 - F.col("present") / F.col("span"))


def gaps(msgs: DataFrame, block: int = 32_768, by: list[str] = ("f",)) -> DataFrame:
    """(by,) first, last, n: each run of numbers that are missing between two that occur. ``block``: numbers windowed together."""
    by = list(by)
    rows = msgs.where("seq is not null").select(*by, "seq").distinct().withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_seq", F.col("seq"))
    step = previous(rows, "_seq", ["seq"], "_block", "_was", by)
    return step.where("seq - _was > 1").select(*by, (F.col("_was") + 1).alias("first"), (F.col("seq") - 1).alias("last"), (F.col("seq") - F.col("_was") - 1).alias("n"))
