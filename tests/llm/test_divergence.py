"""The source audit against DuckDB and plain Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tickweave.llm import divergence
from tickweave.llm import queries as q


def plain(rows, least=10, top=10):
    """The audit of (text, lang, source) rows, one definition after the other."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[0])] for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, total, group = Counter(), Counter(), defaultdict(Counter)
        for r, w in zip(rows, words, strict=True):
            if r[1] == lang:
                docs.update(set(w))
                total.update(w)
                group[r[2]].update(w)
        kept = [t for t in docs if docs[t] >= least]

        def law(count, kept=kept):
            size = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // size for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        laws, whole = {s: law(c) for s, c in group.items()}, law(total)
        for s, p in laws.items():
            pairs = [(sum(f(p[t], o[t]) for t in kept), i) for i, o in laws.items() if i != s]
            terms = [(f(p[t], whole[t]), t) for t in kept if group[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(ranked)]
    return sorted(out)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "Über", "x1y", "ñ", "漢字", "ÀB", "zz", "é́", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "b", "", None, "hot", "hot", "hot"] + [f"s{k}" for k in range(30)])) for _ in range(n)]
    return [*rows, (None, "en", "nothing"), ("alone", "solo", "one"), *[("the the of", "en", "hot")] * 40]


@pytest.mark.parametrize(("block", "run", "chunk"), [(16, 64, 4096), (3, 1, 4), (1, 2, 7)])
def test_tiles_of_any_size_give_the_definition(spark, block, run, chunk):
    rows = random_rows(400, 3)
    df = spark.createDataFrame([(t, lang, s, 5, "x") for t, lang, s in rows], "text string, lang string, source string, term int, value string")
    got = sorted(tuple(r) for r in divergence.audit(df, 10, 10, block, run, chunk).collect())
    assert got == plain(rows)


def test_query_sql_and_definition_agree(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in q.op13_source_divergence(spark, d).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.execute(q.ORACLES["op13_source_divergence"]).fetchall())
    assert got == plain([(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_empty_table_rare_words_and_a_long_text(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rare = divergence.audit(spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t")], schema)).collect()
    assert sorted(tuple(r) for r in rare) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    rows = [("long word " * 300_000, "en", "s"), *[("word", "en", "t")] * 12]
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema)).collect()) == plain(rows)


def test_counts_beyond_products_of_64_bits(spark):
    n, size, terms = 4 * 10**13, 9 * 10**13, 10**7
    got = spark.range(1).select(divergence.scaled(divergence.F.lit(n), divergence.F.lit(size), divergence.F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (size + 2 * terms) == int(divergence.scaled_array(divergence.np.array([n]), size, terms)[0])
