"""Shares of two markets in price discovery. ``non_reference``: published formulas (Hasbrouck 1995, Gonzalo and Granger 1995).

The vector error correction model of two prices x and y of one good,

    dx = a1 z + lags + e1,   dy = a2 z + lags + e2,   z = x - y of the row before,

needs the data only as sums of products of its columns. Those are one aggregate over all
rows (gram); the fit is algebra on that matrix, whose size is that of the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns(lags: int) -> list[str]:
    """The model's columns: constant, z, lagged changes, then the two changes that are explained."""
    return ["one", "z", *[f"d{v}_{k}" for k in range(1, lags + 1) for v in "xy"], "dx", "dy"]


def lagged(prices: DataFrame, lags: int) -> DataFrame:
    """From n (row numbers without gaps), x, y: n and the model's columns, for rows that have them all.

    Each row is handed to the rows after it that need it; there is no window over the whole series.
    """
    reach = F.explode(F.sequence(F.lit(0), F.lit(lags + 1))).alias("k")
    sent = prices.select("n", "x", "y", reach).select((F.col("n") + F.col("k")).alias("n"), "k", "x", "y")
    at = lambda v, k: F.max(F.when(F.col("k") == k, F.col(v)))
    got = sent.groupBy("n").agg(*[at(v, k).alias(f"{v}{k}") for v in "xy" for k in range(lags + 2)])
    change = lambda v, k: F.col(f"{v}{k}") - F.col(f"{v}{k + 1}")
    cells = [F.lit(1).alias("one"), (F.col("x1") - F.col("y1")).alias("z"), *[change(v, k).alias(f"d{v}_{k}") for k in range(1, lags + 1) for v in "xy"], change("x", 0).alias("dx"), change("y", 0).alias("dy")]
    return got.select("n", *cells).dropna()


def gram(model: DataFrame, names: list[str]) -> DataFrame:
    """i, j, total (sum of products) for i <= j: one aggregate over the rows."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = model.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}:{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"{a}:{b}").alias("total")) for a, b in pairs])).alias("p")).select("p.*")


@dataclass(frozen=True)
class Shares:
    """Of x and y: adjustment, covariance of the residuals, component shares, information shares (least and greatest over the two orders)."""

    adjustment: np.ndarray
    covariance: np.ndarray
    component: np.ndarray
    least: np.ndarray
    greatest: np.ndarray


def shares(sums: DataFrame, lags: int) -> Shares:
    """The model fitted from its sums of products (a matrix of 2 lags + 4 rows, brought to the driver)."""
    names = columns(lags)
    place = {n: k for k, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in sums.collect():
        i, j = place[r["i"]], place[r["j"]]
        g[i, j] = g[j, i] = float(r["total"] or 0)
    rhs, n = len(names) - 2, g[0, 0]
    if n <= rhs:
        raise ValueError("fewer rows than coefficients")
    inside, cross, target = g[:rhs, :rhs], g[:rhs, rhs:], g[rhs:, rhs:]
    beta = np.linalg.lstsq(inside, cross, rcond=None)[0]
    omega = (target - cross.T @ beta) / n
    a1, a2 = beta[1]
    weights = np.array([a2, -a1]) / (a2 - a1)  # orthogonal to the adjustment: the common trend's weights
    found = []
    for order in ([0, 1], [1, 0]):
        root = np.linalg.cholesky(omega[np.ix_(order, order)])
        part = (weights[order] @ root) ** 2
        found.append((part / part.sum())[order])
    return Shares(beta[1], omega, weights, np.min(found, axis=0), np.max(found, axis=0))
