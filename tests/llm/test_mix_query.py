"""The mixing query against plain Python over the same documents."""

import re
from collections import Counter

import pytest

from tickweave.llm import mixing
from tickweave.llm import queries as q

DIR = "/root/testdata/sf0.001"


def topic_of(text):
    t = text or ""
    return "tables" if " | " in t else "licensed" if "icense" in t else "shouting" if "!!" in t else "short" if len(t) < 500 else "prose"


def plain(docs):
    """cell -> (rate, probability), one step after the other."""
    cells = Counter()
    for d in docs:
        cells[d["source"] or "(none)", d["lang"] or "(none)", topic_of(d["text"])] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    total, dims = sum(cells.values()), list(q.MIX)
    want = []
    for k, dim in enumerate(dims):
        sums = Counter()
        for c, n in cells.items():
            sums[c[k]] += n
        raised = {v: (n / total) ** q.MIX[dim] if n else 0.0 for v, n in sums.items()}
        want.append({v: x / sum(raised.values()) for v, x in raised.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(2000):
        for k in range(len(dims)):
            now = Counter()
            for c, x in w.items():
                now[c[k]] += x
            w = {c: x * want[k][c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, x in w.items()}
    rate = {c: w[c] * total / n if n else 0.0 for c, n in cells.items()}
    low, high = 0.0, 1 / min(r for r in rate.values() if r > 0)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1.0, mid * rate[c]) for c, n in cells.items()) < q.MIX_PART * total else (low, mid)
    return {c: (r, min(1.0, high * r)) for c, r in rate.items()}, want, total


def test_query_is_the_definition(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want, targets, total = plain(docs)
    rows = q.op8_mix_to_targets(spark, DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        rate, p = want[r["source"], r["lang"], r["topic"]]
        assert r["rate"] == pytest.approx(rate, rel=1e-4, abs=1e-6) and r["p"] == pytest.approx(p, rel=1e-4, abs=1e-6)
        assert r["weight"] == pytest.approx(r["rate"] / r["p"] if r["p"] else 0.0) and (not r["selected"] or r["p"] > 0)
    assert all(r["selected"] for r in rows if r["p"] >= 1)
    # In expectation the sample has the asked tokens and, weighted, the target marginals.
    assert sum(r["p"] * r["n_tokens"] for r in rows) == pytest.approx(q.MIX_PART * total, rel=1e-6)
    for k, dim in enumerate(q.MIX):
        for value, share in targets[k].items():
            got = sum(r["p"] * r["weight"] * r["n_tokens"] for r in rows if (r[dim] or "(none)") == value)
            assert got == pytest.approx(share * total, rel=1e-3, abs=1e-3 * total)
    again = {r["doc_id"]: r["selected"] for r in q.op8_mix_to_targets(spark, DIR).collect()}
    assert again == {r["doc_id"]: r["selected"] for r in rows}


def test_joined_and_driver_fits_agree(spark, monkeypatch):
    rows = [(k, f"w{' x' * (k % 7)}", f"s{k % 5}", f"l{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    wanted = {"source": 0.5, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    few = {r["doc_id"]: (r["rate"], r["p"]) for r in mixing.mix(df, wanted).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    monkeypatch.setattr(mixing, "CLOSE", 1e-6)
    many = {r["doc_id"]: (r["rate"], r["p"]) for r in mixing.mix(df, wanted).collect()}
    assert all(few[k] == pytest.approx(many[k], rel=1e-4) for k in few)
