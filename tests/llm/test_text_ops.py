"""BPE, language ID, quality, chat, urls against plain versions."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickweave.llm import bpe, chat, langid, quality, url_reputation
from tickweave.llm import queries as q

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DIR = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "İ Σίσυφος ΟΔΟΣ ﬁ ǅ", "<|endoftext|>x<|startoftext|> </w>", "don't it'll 12 345 ½ \x00\x1c\x85\u3000", "é" * 3000, "😀👍🏽 漢字かな 한글", "word " * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def documents(spark, texts, **extra):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_bpe_is_the_library_on_random_texts(tokenizer):
    own = bpe.PrefixBpe(bpe.read_spec(PATH))
    rng = random.Random(1)
    alphabet = "abcdeéÀΣσςİı'sStTreLLdD \t\n\x0b\x1c\x85\u30000129²½٣漢한あ😀é#$%&<|>"
    words = ["hello", "'s", "<|endoftext|>", "don't", "ΟΔΟΣ", "counterrevolutionary", "aaaaaaaaaaaa", "hahahahaha"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randint(0, 30)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want and own.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_query_and_operators(spark, tokenizer):
    docs = documents(spark, ODD * 2, ids=5, n_tokens=1).select("ids", "n_tokens", "text", "doc_id")
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, with_ids=True).collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for k, text in enumerate(ODD * 2):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert list(got[k]["ids"]) == ids and got[k]["n_tokens"] == len(ids) and back[k] == decoded
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(docs.where("doc_id < 0"), PATH).count() == 0
    rows = q.op3_prefix_bpe(spark, DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in rows)


def test_languages_are_learned_from_the_learning_part_only(spark):
    rows = q.op7_language_bitmask(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_edges(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and runs ", "le renard brun saute par dessus le chien paresseux "
    train = spark.createDataFrame([(k, (en if k % 2 else fr) * 5, "en" if k % 2 else "fr") for k in range(40)] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string")
    model = langid.learn(train)
    assert model.languages == ["en", "fr"]
    texts = [None, "", "123 !?", en, fr.upper(), (en * 3 + " 77 ") * 20000]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, texts, lang="zz", score=1), model).collect()}
    assert [got[k]["lang_pred"] for k in range(6)] == ["und", "und", "und", "en", "fr", "en"] and got[0]["score"] == 0
    kept = langid.keep_identified(documents(spark, texts, lang="zz"), model).collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(3, "en"), (4, "fr"), (5, "en")]
    none = langid.learn(train.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, texts), none).collect()} == {"und"}
    # Pieces of a long text count as the whole does.
    whole = model.counts([en * 50])
    old = langid.CHUNK
    try:
        langid.CHUNK = 100
        assert all((a == b).all() for a, b in zip(whole, model.counts([en * 50]), strict=True))
    finally:
        langid.CHUNK = old


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\nx y\n" * rng.randint(0, 4) for _ in range(150)]
    found = quality.ledger(documents(spark, texts, n_words=1, failed=2))
    rows = {r["doc_id"]: r for r in found.collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        n, chars, symbols, dup, rep = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), text
        assert bool(r["failed"] & 1) == (n < 20) and bool(r["failed"] & 2) == (100 * rep > 30 * n)
    want = Counter()
    m = quality.mask("v2")
    for r in rows.values():
        for bit, (name, _) in enumerate(quality.RULES):
            want[name, "failed"] += bool(r["failed"] & m & (1 << bit))
            want[name, "alone"] += (r["failed"] & m) == (1 << bit)
    for r in quality.ablations(found, "v2").collect():
        assert (r["failed"], r["rejected_alone"]) == (want[r["rule"], "failed"], want[r["rule"], "alone"])


def test_chat_round_trip(spark):
    tokens = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", "<|", "&lt;"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None, "[/INST]", "assistant"]), "".join(rng.choice(tokens) for _ in range(rng.randint(0, 9))) if rng.random() > 0.05 else None) for c in range(150) for t in range(rng.randint(1, 4))]
    rows += [(500, 1, "user", "b"), (500, 1, "user", "b"), (500, 1, "assistant", "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for conv in {r[0] for r in rows}:
        source = [(r or "", t or "") for _, r, t in sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv)]
        got = out[conv]
        assert got["round_trip"] and [tuple(t) for t in got["turns"]] == source
        assert len(re.findall(r"<s>|</s>|\[/?INST\]", got["formatted"])) == 4 * len(source)
        masked = [got["formatted"][x["start"] : x["start"] + x["length"]] for x in got["loss_mask"]]
        assert [re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", x) if got["escaped"] else x for x in masked] == [t for r, t in source if r == "assistant"]
    assert chat.format_chats(df.where("turn < 0")).count() == 0


def test_the_grammar_refuses_what_it_does_not_say(spark):
    whole = "<s>[INST]user[/INST]hi</s>"
    texts = [whole, whole + "x", "x" + whole, "<s>[INST]user hi</s>", "<s>[INST]a[/INST]b[/INST]c</s>", "<s>[INST]a[/INST]<s>b</s>", "", whole * 2]
    got = documents(spark, texts).select("doc_id", chat.parse(F.col("text")).alias("turns")).orderBy("doc_id").collect()
    assert [None if r["turns"] is None else len(r["turns"]) for r in got] == [1, None, None, None, None, None, 0, 2]


def test_registered_domains(spark):
    want = {
        "a.com.mx": ("a.com.mx", "com.mx"), "b.a.com.mx:80": ("a.com.mx", "com.mx"), "x.gov.uk": ("x.gov.uk", "gov.uk"), "1.2.3.4": ("1.2.3.4", "(address)"), "www.x.org": ("x.org", "org"),
        "com": ("com", "com"), "": ("", ""), "u.blog.example.net": ("u.blog.example.net", "blog.example.net"), "[::1]": ("[::1]", "(address)"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_reputation.with_levels(hosts, spark.createDataFrame([("blog.example.net",), ("net",)], "s string")).collect()}
    assert got == want


def test_many_languages_and_rows_without_ids(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]
    some = lambda k: " ".join("".join(rng.choice(alphabet[6 * k : 6 * k + 6]) for _ in range(4)) for _ in range(30))
    rows = [(None, some(k), f"l{k:02d}") for k in range(70) for _ in range(6)]
    model = langid.learn(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), min_count=2)
    assert len(model.languages) == 70 and model.table.shape[0] == 2
    names, score, _ = model.predict([some(k) for k in range(70)])
    assert names == [f"l{k:02d}" for k in range(70)] and score.min() > 0.8


def plain_rule(host, path):
    best = None
    for verdict, h, p in q.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q=1#f", "https://a.net/es/1", "https://net/fr/", "ftp://x.org?y", "http://b.example.com/en", "http://É.com/A#b?c", "http://h.co.uk/p", "a://b://c/d", "http://xexample.com/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls * 2)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([("http://spam.org/1", 1)] * 60 + [("http://good.org/1", 0)] * 60 + [("http://x.org", None), (None, 1)], "url string, bad int")
    pages = pages.unionByName(spark.createDataFrame([(100, "http://spam.org/2"), (101, "http://good.org/2"), (102, "http://new.org/")], "page_id long, url string"), allowMissingColumns=True)
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, bad, q.URL_RULES).collect()}
    assert len(got) == 2 * len(urls) + 3
    for k, url in enumerate(urls):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (got[k]["host"], got[k]["path"]) == (host, path) and (got[k]["rule"], got[k]["verdict"]) == (plain_rule(host, path)[0], plain_rule(host, path)[1] or got[k]["verdict"])
    assert (got[100]["verdict"], got[101]["verdict"], got[102]["verdict"]) == ("block", "allow", "allow")
    assert got[101]["bad_mean"] < got[102]["bad_mean"] < got[100]["bad_mean"]  # an unknown host gets its suffix's rate
    empty = url_reputation.judge_urls(pages, bad.where("bad > 5"), q.URL_RULES)
    assert empty.where("rule is null and verdict <> 'allow'").isEmpty() and url_reputation.judge_urls(pages.where("page_id < 0"), bad, []).count() == 0


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
