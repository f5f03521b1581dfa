"""The bench runs to its end and prints one JSON line."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_seconds_rows_and_shuffle():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1", "BENCH_ONLY": "msg_bucket_agg,lob_levels_by_fold", "BENCH_FEED": "200"}
    done = subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=True)
    got = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(got["queries"]) == set(got["rows"]) == set(got["shuffle_mb"]) == {"msg_bucket_agg", "lob_levels_by_fold"}
    assert got["unit"] == "sec" and got["value"] > 0 and got["rows"]["msg_bucket_agg"] > 0 and got["shuffle_mb"]["msg_bucket_agg"] > 0
    assert set(got["one_feed"]["200"]) == {"windows", "fold"}


def test_staged_tables_go_with_their_scratch(spark):
    from tickweave import staging

    kept = staging.staged(spark.range(3), "kept")
    with staging.scratch(spark):
        gone = staging.staged(spark.range(3), "gone")
        paths = gone.inputFiles()
        assert gone.count() == 3
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths) and kept.count() == 3
