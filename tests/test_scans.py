"""Sums with a bound over blocks, and modifies whose effect depends on one another."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import blocks, book
from tickweave.operators.fold import fold_book
from tickweave.operators.ordering import ordered_events
from tickweave.schemas import EVENTS


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_bounded_sum_is_the_loop_whatever_the_blocks(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice("ab"), float(rng.randint(-5, 5)), rng.choice([None, 0.0, 0.0, 2.0]), rng.random() < 0.1) for k in range(200)]
    df = spark.createDataFrame([(k, g, a, 1.0 if r else b, r) for k, g, a, b, r in rows], "k int, g string, a double, b double, r boolean").repartition(3)
    got = blocks.bounded_sum(df.withColumn("_b", F.floor(F.col("k") / size)), F.col("a"), F.col("b"), F.col("r"), F.col("k"), ["k"], "_b", ["g"], "v").collect()
    value, last = {"a": 0.0, "b": 0.0}, {"a": None, "b": None}
    by_k = {r["k"]: r for r in got}
    for k, g, a, b, r in rows:
        assert (by_k[k]["v_before"], by_k[k]["carry_before"]) == (value[g], last[g])
        value[g] = 1.0 if r else value[g] + a if b is None else max(value[g] + a, b)
        last[g] = k
        assert by_k[k]["v"] == value[g]


def chains(rng, n=160):
    """Few references, many modifies to a size of 0: whether one takes effect depends on others."""
    rows = []
    for k in range(n):
        code = rng.choice(["ADD", "ADD", "CANCEL", "MODIFY", "MODIFY", "MODIFY", "TRADE"])
        ref, prev = rng.sample("abcd", 2)
        qty = 0.0 if code == "MODIFY" and rng.random() < 0.7 else float(rng.randint(1, 9))
        rows.append((rng.choice(["A", "B"]), code, rng.choice(["Bid", "Ask"]), float(rng.randint(1, 3)), qty, None if rng.random() < 0.05 else ref, prev if code == "MODIFY" else ref, True, k, 1000 * k, k))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_modifies_that_hang_on_others_equal_the_fold(spark, seed):
    ordered = ordered_events(spark.createDataFrame(chains(random.Random(seed)), EVENTS).repartition(3)).cache()
    odd = ordered.where(book._odd())
    assert odd.count() > 30 and 0 < book.fired(book.order_steps(ordered), odd).count() < odd.count()

    def last(df):
        pdf = df.toPandas().sort_values(["f", "k1", "k2", "arrival", "sub"], kind="stable")
        return pdf.groupby(["f", "arrival", "side", "price"])["level"].last().clip(lower=0)

    both = pd.concat([last(book.levels(ordered)), last(fold_book(ordered))], axis=1, keys=["windows", "fold"]).fillna(0.0)
    assert len(both) and ((both["windows"] - both["fold"]).abs() < 1e-9).all()


def test_no_python_in_the_plans(spark):
    """Neither trades without an order nor malformed modifies leave the JVM."""
    rows = [("A", "ADD", "Bid", 2.0, 5.0, "a", "a", True, 1, 1, 1), ("A", "TRADE", "Bid", 2.0, 1.0, "zz", "zz", True, 2, 2, 2), ("A", "MODIFY", "Bid", 2.0, 0.0, "a", "b", True, 3, 3, 3), ("A", "LEVEL_SET", "Bid", 3.0, 1.0, None, None, True, 4, 4, 4)]
    ordered = ordered_events(spark.createDataFrame(rows, EVENTS))
    for df in (book.levels(ordered), book.replay_stats(ordered)):
        plan = df._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
