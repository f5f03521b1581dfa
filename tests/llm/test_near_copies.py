"""Recall of near_copies() against brute force, with edits at the start, in the middle and at the end."""

import random

from tickweave.llm import fingerprint


def test_near_copies_wherever_the_edits_are(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    junk = lambda n: "".join(rng.choice("abcdefghij   ") for _ in range(n))
    rows = []
    for k in range(12):
        t = " ".join(rng.choice(words) for _ in range(1200))
        half = len(t) // 2
        near = [t, junk(60) + t[60:], junk(150) + t[150:], t[:half] + junk(150) + t[half + 150 :], t[:-150] + junk(150), t[:-200]]
        rows += [(10 * k + i, x) for i, x in enumerate(near)]
    got = {r["doc_id"]: r["n_links"] for r in fingerprint.near_copies(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    prints = {i: fingerprint.fingerprint(t) for i, t in rows}
    links = {i: sum(fingerprint.likeness(prints[i], prints[j]) >= 0.8 for j in prints if j != i) for i in prints}
    assert got == links and all(sum(links[10 * k + i] > 0 for k in range(12)) >= 6 for i in range(6))
