"""The replay deals its rows out by their number, however few shuffle partitions are set."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_scans import chains
from tickweave.operators import blocks, book
from tickweave.operators.ordering import ordered_events
from tickweave.schemas import EVENTS


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 60)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_the_replay_grow_with_the_events(spark, small_tasks):
    """Many references and prices: no task holds more than a few times its share."""
    rows = [(f"F{k % 2}", "ADD" if k % 4 < 2 else "CANCEL", "Bid", float(1 + k // 4), 5.0, str(k // 4), str(k // 4), True, k, 1000 * k, k) for k in range(800)]
    ordered = ordered_events(spark.createDataFrame(rows, EVENTS), block=5)
    life = book.lifecycle(ordered)
    for df in (ordered, life, book.levels(ordered, life)):
        assert df.count() >= 600 and most_in_a_task(df) <= 180


@pytest.mark.parametrize("seed", range(2))
def test_counters_of_modifies_that_move_an_order_onto_another(spark, seed):
    """dup_add by the fold's own rule: an add onto a resting order, or a modify that takes a resting one away and sets another resting one."""
    rng = random.Random(seed)
    rows = [r for r in chains(rng, 300) if r[4] > 0]
    ordered = ordered_events(spark.createDataFrame(rows, EVENTS)).cache()
    resting, dup, lost = {}, 0, {"CANCEL": 0, "TRADE": 0}
    for f, code, _, _, qty, ref, prev, *_ in rows:
        book_, mine = resting.setdefault(f, {}), ref is not None
        if code == "ADD":
            dup += mine and ref in book_
            if mine:
                book_[ref] = qty
        elif code == "MODIFY":
            took = prev is not None and prev != ref and book_.pop(prev, None) is not None
            dup += took and mine and ref in book_
            if mine:
                book_[ref] = qty
        elif not mine or ref not in book_:
            lost[code] += 1
        elif code == "CANCEL" or book_[ref] <= qty:
            del book_[ref]
        else:
            book_[ref] -= qty
    one = book.replay_stats(ordered).first()
    assert dup > 0 and (one["dup_add"], one["cancel_no_order"], one["trade_no_ref"] + one["trade_on_mbp_skipped"]) == (dup, lost["CANCEL"], lost["TRADE"])
    by = book.replay_stats(ordered, by=F.col("f")).agg(F.sum("dup_add"), F.sum("cancel_no_order")).first()
    assert tuple(by) == (dup, lost["CANCEL"])


def test_files_of_logs_are_as_many_as_folders_and_tasks(spark, tmp_path):
    """A task writes few folders: files are not tasks times folders."""
    from tickweave import log_queries as logs

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = logs.numbered(spark, "/root/testdata/sf0.001").withColumn("folder", F.when(F.col("user_id") % 2 == 0, "d/EVEN").otherwise("d/ODD"))
        logs.write_logs(rows, f"file://{tmp_path}", ["d/EVEN", "d/ODD"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "d").glob("*/*/*.csv"))
    assert len({f.parent for f in files}) == 12 and len(files) < 12 + 4
