"""Quantiles of many parts from sketches that can be merged (KLL).

A sketch is a few KB whatever it has seen; those of parts (feeds by hour) are written once and
merged to feeds, days or all. The rank of an answer is off by at most RANK_ERROR of
the rows, in 99 of 100 sketches (for K, by the sketch's published bounds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter, and the normalized rank error that goes with it.
K, RANK_ERROR = 1000, 0.01


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def sketched(rows: DataFrame, by: list[str], value: str = "price", k: int = K) -> DataFrame:
    """(by,) n (values), sketch; groups without a finite value are left out."""
    x = finite(F.col(value))
    return rows.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by,) n, sketch of the parts together."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(q: float, sketch: str | Column = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def rank_errors(rows: DataFrame, answers: DataFrame, by: list[str], q: float, value: str = "price") -> DataFrame:
    """(by,) n, error: how far the answers' true ranks (column ``answer``) are from ``q``, as a share of the rows; one more pass over them."""
    x = finite(F.col(value))
    pairs = rows.where(x.isNotNull()).join(answers.select(*by, "answer"), by) if by else rows.where(x.isNotNull()).join(answers.select("answer"))
    got = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(x < F.col("answer"), 1)).alias("under"), F.count(F.when(x <= F.col("answer"), 1)).alias("upto"))
    off = F.greatest(F.col("under") / F.col("n") - q, q - F.col("upto") / F.col("n"), F.lit(0.0))
    return got.select(*by, "n", off.alias("error"))
