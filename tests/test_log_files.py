"""Logs keep the order of their rows when the sorts of the write spill."""

import csv
import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from tickweave import log_queries

DIR = "/root/testdata/sf0.001"
THRESHOLD = "spark.shuffle.spill.numElementsForceSpillThreshold"


@pytest.fixture
def spilling(spark):
    """Sorts spill after every 100 rows."""
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set(THRESHOLD, "100")
    yield spark
    conf.remove(THRESHOLD)


@pytest.mark.parametrize("folder", ["'d/P'", "CASE user_id % 2 WHEN 0 THEN 'd/P' WHEN 1 THEN 'd/Q' END"], ids=["one", "nullable"])
def test_files_are_in_the_order_of_event_id(spilling, tmp_path, folder):
    rows = log_queries.numbered(spilling, DIR)
    log_queries.write_logs(rows.withColumn("folder", F.expr(folder)), f"file://{tmp_path}", ["d/P", "d/Q"])
    seen = 0
    for kind in glob.glob(f"{tmp_path}/d/*/*"):
        ids = [int(r["tradereferencenumber"]) for part in sorted(glob.glob(f"{kind}/part-*")) for r in csv.DictReader(open(part))]
        assert ids == sorted(ids)
        seen += len(ids)
    assert seen == rows.count()


@pytest.mark.parametrize("name", ["log_levels", "log_stats"])
def test_queries_equal_their_sql(spilling, tmp_path, name):
    db = duckdb.connect()
    # Half of the rows have no sequence: their order in the files decides what rests.
    db.execute(f"CREATE VIEW events AS SELECT * REPLACE (event_id * 33 + event_id % 2 AS event_id, user_id % 30 AS user_id) FROM '{DIR}/events.parquet'")
    db.execute(f"COPY (SELECT * FROM events ORDER BY event_id) TO '{tmp_path}/events.parquet'")
    got = log_queries.QUERIES[name](spilling, f"file://{tmp_path}")
    cur = db.execute(log_queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
