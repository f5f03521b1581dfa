"""Classes from few verified pairs are those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_ops import brute_links
from tickweave.llm import jaccard


def chain(rng, words, n, step):
    """Texts each like the one before, not like those far off."""
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for k in range(n):
        base[(k * step) % 60] = f"new{k}"
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize(("block", "seed"), [(2, 0), (5, 1), (512, 2)])
def test_classes_equal_all_pairs(spark, monkeypatch, block, seed):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(10)] + chain(rng, words, 30, 7) + chain(rng, words, 12, 11) + [None, "", "one two"] + ["one two"]
    star = [rng.choice(words) for _ in range(80)]
    for k in range(25):  # copies of one text, far from each other
        copy = list(star)
        copy[k * 3] = f"s{k}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    _, label = brute_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    want = {min(k for k in range(len(texts)) if label[k] == label[j]) for j in range(len(texts)) if texts[j] and texts[j].split()}
    assert kept == want | {k for k, t in enumerate(texts) if not t}


def test_large_groups_verify_few_pairs(spark, monkeypatch):
    """A group of m near copies ships each set a few times, not m / BLOCK times."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for k in range(160):
        copy = list(base)
        copy[rng.randint(0, 119)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shipped = []
    plain = jaccard.joined
    monkeypatch.setattr(jaccard, "joined", lambda units, *a, **b: shipped.append(units.count()) or plain(units, *a, **b))
    assert [r["doc_id"] for r in jaccard.keep_one(df).collect()] == [0]
    assert sum(shipped[1:]) <= 2 * len(rows)  # the first one compares signatures
    assert jaccard.keep_one(df.where(F.col("doc_id") < 0)).count() == 0
