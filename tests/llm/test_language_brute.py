"""Language identification against exact sets of n-grams in place of Bloom filters."""

import zlib
from collections import Counter, defaultdict

from tickweave.llm import queries as q

DIR = "/root/testdata/sf0.001"


def grams(text):
    """(size, n-gram) of a text: non-letters are boundaries, which may only stand at an end."""
    s = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    for n in (2, 3, 4):
        for k in range(len(s) - n + 1):
            g = s[k : k + n]
            if (g != "\0\0") if n == 2 else "\0" not in g[1:-1]:
                yield n, g


def learned(docs):
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and d["text"]:
            counts[d["lang"]].update(grams(d["text"]))
    rates = {}
    for lang, c in counts.items():
        often = {g: n for g, n in c.items() if n >= 3}
        sums = Counter()
        for (size, _), n in often.items():
            sums[size] += n
        rates[lang] = {g: n / sums[g[0]] for g, n in often.items()}
    top = Counter()
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    return {lang: {g for g, x in r.items() if x >= 0.25 * top[g]} for lang, r in rates.items()}


def test_query_is_the_definition_but_for_false_positives(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    sets = learned([d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5])
    rows = {r["doc_id"]: r for r in q.op7_language_bitmask(spark, DIR).collect()}
    same = 0
    for d in docs:
        found = Counter(grams(d["text"] or ""))
        by = sorted(((sum(n for g, n in found.items() if g in s), lang) for lang, s in sets.items()), reverse=True)
        r = rows[d["doc_id"]]
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            same += 1
            continue
        score = by[0][0] / (by[0][0] + by[1][0]) if by[0][0] else 0.0
        same += r["lang_pred"] == by[0][1] and abs(r["score"] - score) < 0.01
    assert same >= 0.99 * len(docs)
