"""Rows without an id are drawn one by one."""

import pytest
from pyspark.sql import functions as F

from tickweave.llm import mixing


def test_rows_without_an_id_meet_the_token_target(spark):
    rows = [(None, f"w{k} " + "w " * (k % 7), "a") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": 1.0}, 0.5)
    got = out.agg(F.sum(F.when(F.col("selected"), F.col("n_tokens"))), F.sum("n_tokens")).first()
    assert got[0] is not None and got[0] / got[1] == pytest.approx(0.5, rel=0.1)
    kept = mixing.sample(df, {"source": 1.0}, 0.5)
    assert kept.count() == out.where("selected").count()


def test_equal_rows_and_shared_ids_are_drawn_one_by_one(spark):
    rows = [(None, "w w w", "a")] * 1000 + [(7, f"x{k} y", "a") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": 1.0}, 0.5).groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("selected"), 1)).alias("k")).collect()
    assert all(r["n"] == 1000 and 400 < r["k"] < 600 for r in out) and len(out) == 2
    assert 800 < mixing.sample(df, {"source": 1.0}, 0.5).count() < 1200


def test_joins_fit_as_the_driver_does(spark, monkeypatch):
    rows = [(k, "w " * (k % 9), "abc"[k % 3], "xy"[k % 7 == 0]) for k in range(600)] + [(1000 + k, "", "d", "x") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    wanted = {"source": {"a": 0.7, "b": -0.2, "c": 0.3}, "lang": 0.0}
    few = mixing.mix(df, wanted, 0.4).toPandas().sort_values("doc_id")
    monkeypatch.setattr(mixing, "MAX_CELLS", 1)
    monkeypatch.setattr(mixing, "SWEEPS", 12)
    many = mixing.mix(df, wanted, 0.4).toPandas().sort_values("doc_id")
    assert many["p"].to_numpy() == pytest.approx(few["p"].to_numpy(), abs=1e-3) and few["gap"].max() < 1e-6
