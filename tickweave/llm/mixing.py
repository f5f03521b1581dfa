"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token weights of the cells
are raked until each marginal has its target shares. A document is then sampled
with probability min(1, c * rate of its cell), c calibrated so that the expected
tokens are the asked part of all; ``weight`` is what is left of the rate, so
weighted tokens of the sample have the target marginals in expectation.

Only cells (not documents) are fitted. They come to the driver while they are at
most ``MAX_CELLS``; beyond that the same sweeps run as joins of staged tables, by the
same formulas and to the same end. Sweeps stop when every share is within ``CLOSE`` of
its target, or after ``SWEEPS``; ``gap`` says how far the farthest share then is (targets
that no weights can meet leave one).

Defined cases: null values of a dimension are the value ``(none)``; documents
without tokens have probability 0 if their cell has no tokens at all, else their
cell's; a target value that does not occur is ignored, a value without target
keeps its share of the tokens; negative targets are 0; an empty table gives no rows.
Drawing is by a hash of id, text and seed, so rows that share an id, or have none, are
drawn each by their text; rows equal in both are told apart by their place in the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_CELLS = 100_000
SWEEPS, CLOSE = 500, 1e-9
WORDS = r"[^\x20\x09-\x0D]+"


def shares(totals: dict[str, float], wanted: dict[str, float] | float) -> dict[str, float]:
    """Target shares of a dimension's values: given ones, or token shares to a power (tempering)."""
    everything = sum(totals.values()) or 1.0
    if not isinstance(wanted, dict):
        raised = {k: (v / everything) ** wanted if v > 0 else 0.0 for k, v in totals.items()}
        total = sum(raised.values()) or 1.0
        return {k: v / total for k, v in raised.items()}
    given = {k: max(0.0, wanted[k]) for k in totals if k in wanted}
    rest = {k: v / everything for k, v in totals.items() if k not in wanted}
    left = max(0.0, 1.0 - sum(rest.values()))
    total = sum(given.values()) or 1.0
    return rest | {k: v / total * left for k, v in given.items()}


def gap_of(cells: pd.DataFrame, w: np.ndarray, dims: list[str], targets: dict[str, dict[str, float]]) -> float:
    """How far the farthest share is from its target (of values that have weight)."""
    off = 0.0
    for d in dims:
        now = pd.Series(w).groupby(cells[d].to_numpy()).sum()
        off = max([off, *(abs(targets[d][v] - x) for v, x in now.items() if x > 0)])
    return off


def rake(cells: pd.DataFrame, dims: list[str], targets: dict[str, dict[str, float]]) -> np.ndarray:
    """Fitted token weights of the cells (they sum to 1), marginals as ``targets``."""
    w = cells["tokens"].to_numpy(float) / max(1.0, cells["tokens"].sum())
    coded = {d: cells[d].astype("category").cat for d in dims}
    for _ in range(SWEEPS):
        off = 0.0
        for d in dims:
            code, values = coded[d].codes.to_numpy(), coded[d].categories
            now = np.bincount(code, w, len(values))
            want = np.array([targets[d][v] for v in values])
            factor = np.divide(want, now, out=np.zeros_like(want), where=now > 0)
            off = max(off, float(np.abs(want - now)[now > 0].max(initial=0.0)))
            w = w * factor[code]
        if off < CLOSE:
            break
    return w


def calibrated(tokens: np.ndarray, rate: np.ndarray, part: float) -> np.ndarray:
    """Probabilities min(1, c * rate) whose expected tokens are ``part`` of all that have a rate."""
    goal, total = part * tokens.sum(), tokens[rate > 0].sum()
    if goal >= total or not total:
        return (rate > 0).astype(float)
    low, high = 0.0, 1.0 / rate[rate > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * rate)).sum() < goal else (low, mid)
    return np.minimum(1, high * rate)


def cell_rates(cells: DataFrame, dims: list[str], wanted: dict, part: float) -> DataFrame:
    """cells(dims, tokens) -> dims, rate, p, weight."""
    spark = cells.sparkSession
    few = cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    if few:
        rows = cells.toPandas()  # at most MAX_CELLS
        targets = {d: shares(rows.groupby(d)["tokens"].sum().astype(float).to_dict(), wanted[d]) for d in dims}
        tokens = rows["tokens"].to_numpy(float)
        fitted = rake(rows, dims, targets) * tokens.sum()
        rate = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
        p = calibrated(tokens, rate, part)
        rows = rows[dims].assign(rate=rate, gap=gap_of(rows, fitted / max(1.0, tokens.sum()), dims, targets), p=p, weight=np.divide(rate, p, out=np.zeros_like(rate), where=p > 0))
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", rate double, gap double, p double, weight double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    live = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for sweep in range(SWEEPS):
        worst = 0.0
        for d in dims:
            margin = live.groupBy(d).agg(F.sum("w").alias("now"), F.sum("tokens").alias("n"))
            if isinstance(wanted[d], dict):
                pairs = [x for k, v in wanted[d].items() for x in (F.lit(k), F.lit(float(v)))]
                given = F.greatest(F.lit(0.0), F.element_at(F.create_map(*pairs), F.col(d))) if pairs else F.lit(None).cast("double")
                given = F.when(F.element_at(F.create_map(*pairs), F.col(d)).isNotNull(), given) if pairs else given
                base = F.col("n") / F.lit(float(total))
                sums = margin.agg(F.sum(F.when(given.isNull(), base)), F.sum(given)).first()
                want = F.coalesce(given / F.lit(sums[1] or 1.0) * F.lit(max(0.0, 1 - (sums[0] or 0.0))), base)
            else:
                power = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(total)), F.lit(float(wanted[d])))).otherwise(0.0)
                want = power / F.lit(margin.agg(F.sum(power)).first()[0] or 1.0)
            factors = staged(margin.select(d, want.alias("want"), "now"), "rake-margin")
            worst = max(worst, factors.where("now > 0").agg(F.max(F.abs(F.col("want") - F.col("now")))).first()[0] or 0.0)
            live = live.join(factors, d).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col("want") / F.col("now")).otherwise(0.0)).drop("want", "now")
        live = staged(live, "rake-sweep")
        if worst < CLOSE:
            break
    gap = worst
    rated = live.withColumn("rate", F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(0.0))
    low, high = 0.0, 1.0 / (rated.where("rate > 0").agg(F.min("rate")).first()[0] or 1.0)
    for _ in range(50):
        mid = (low + high) / 2
        got = rated.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("rate") * mid))).first()[0] or 0.0
        low, high = (mid, high) if got < part * total else (low, mid)
    p = F.least(F.lit(1.0), F.col("rate") * high)
    return rated.select(*dims, "rate", F.lit(gap).alias("gap"), p.alias("p"), F.when(p > 0, F.col("rate") / p).otherwise(0.0).alias("weight"))


def _dims(wanted: dict) -> list:
    return [F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in wanted]


def _tokens(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def _with_draw(rows: DataFrame, id_col: str, h: str, seed: int) -> DataFrame:
    """rows with ``_draw`` in [0, 1): of (id, h) and the seed, and for rows equal in both also of their place."""
    key = F.xxhash64(id_col, h, F.lit(seed))
    unit = lambda x: F.pmod(x, F.lit(1 << 53)) / F.lit(float(1 << 53))
    again = rows.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    if again.isEmpty():
        return rows.withColumn("_draw", unit(key))
    placed = rows.withColumns({"_key": key, "_at": F.monotonically_increasing_id()})
    marked = placed.join(again.withColumn("_many", F.lit(True)).hint("shuffle_hash"), "_key", "left")
    return marked.withColumn("_draw", unit(F.when(F.col("_many"), F.xxhash64("_key", "_at")).otherwise(F.col("_key")))).drop("_key", "_at", "_many")


def _rows(docs: DataFrame, wanted: dict, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the dimensions, n_tokens, _draw of every row: no texts."""
    text = F.col(text_col).cast("string")
    one = docs.select(F.col(id_col).alias("doc_id"), *_dims(wanted), _tokens(text_col).alias("n_tokens"), F.xxhash64(text).alias("_h"))
    return _with_draw(staged(one, "mixing"), "doc_id", "_h", seed)


def sample(docs: DataFrame, wanted: dict[str, dict[str, float] | float], part: float = 0.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that mix() selects (of rows equal in id and text, as many as drawn), with all their columns.

    While cells are few, texts are not shuffled unless rows repeat.
    """
    dims = list(wanted)
    cells = docs.select(*_dims(wanted), _tokens(text_col).alias("n")).groupBy(*dims).agg(F.sum("n").alias("tokens"))
    rates = cell_rates(staged(cells, "cells"), dims, wanted, part).select(*[F.col(d).alias(f"_mix_{d}") for d in dims], F.col("p").alias("_mix_p"))
    match = [F.coalesce(F.col(d).cast("string"), F.lit("(none)")) == F.col(f"_mix_{d}") for d in dims]
    drawn = _with_draw(docs.withColumn("_mix_h", F.xxhash64(F.col(text_col).cast("string"))), id_col, "_mix_h", seed)
    return drawn.join(rates, match).where(F.col("_draw") < F.col("_mix_p")).select(*docs.columns)


def mix(docs: DataFrame, wanted: dict[str, dict[str, float] | float], part: float = 0.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the dimensions, n_tokens (words), rate, gap, p, weight, selected.

    wanted: dimension (a column) -> target shares, or a power for tempered shares.
    """
    dims = list(wanted)
    one = _rows(docs, wanted, seed, id_col, text_col)
    cells = one.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens"))
    rated = one.join(cell_rates(cells, dims, wanted, part), dims, "left")
    p = F.coalesce("p", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rated.select("doc_id", *dims, "n_tokens", zero("rate"), "gap", p.alias("p"), zero("weight"), (F.col("_draw") < p).alias("selected"))
