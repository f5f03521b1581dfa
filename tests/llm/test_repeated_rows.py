"""Suffix dedup of many rows that repeat id and text."""

import random
import time

from tests.llm.test_corpus_ops import brute_kept
from tickweave.llm import suffix_dedup as sd

N = 500


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    base = " ".join(rng.choices(words, k=150))
    other = " ".join(rng.choices(words, k=150))
    return base, f"{other[:200]} {base[100:420]} {other[200:]}"


def run(spark, rows):
    began = time.perf_counter()
    got = sorted((r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    return got, time.perf_counter() - began


def test_repeated_rows_cost_what_own_ids_cost(spark):
    base, mixed = texts()
    own = [(k, base) for k in range(N)] + [(N, mixed), (N + 1, mixed[::-1])]
    same = [(7, base)] * N + [(7, mixed), (8, mixed[::-1])]
    run(spark, own[:3])
    (want, quick), (got, took) = run(spark, own), run(spark, same)
    assert got == want and len(got) == N + 2
    # A string's copies beyond the second change nothing: the plain version of three rows says what goes.
    kept = dict(zip(("base", "mixed", "back"), brute_kept([base, base, mixed, mixed[::-1]], 200)[1:], strict=True))
    assert {r[2] for r in got} == {x[0] for x in kept.values()}
    assert took < 2 * quick + 2
