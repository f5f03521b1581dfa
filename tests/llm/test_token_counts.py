"""Token counts of all prefixes against the tokenizers library."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickweave.llm import bpe, token_counts
from tickweave.llm import queries as q

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   \n\n x", "a" * 5000, "<|endoftext|><|endoftext|>  <|endof", "we'll they're 'v 'll", "é" * 3000, "😀👍🏽 漢字かな 한글", "\x00\x1c\x85　½", "word  " * 3000, "word  " * 3000]


@pytest.fixture(scope="module")
def n():
    library = Tokenizer.from_file(PATH)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_the_library(n):
    newer = token_counts.newer_letters(PATH)
    own = token_counts.TokenCounter(bpe.read_spec(PATH), newer)
    rng = random.Random(5)
    alphabet = "abcdeéÀΣσςİı'sStTreLLdDvm \t\n\x0b\x1c\x85　0129²½٣漢한あ😀é#$%&<|>  \n" + (newer[:1] + newer[-1:])
    words = ["hello", "'s", "<|endoftext|>", "don't", "'re", "we'll", "   ", "\n\n", " \n ", "counterrevolutionary", "aaaaaaaaaaaa", " the", "<|endof", "00000000", "        "]
    for _ in range(1200):
        text = "".join(rng.choice(alphabet) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randint(0, 20)))
        want = [n(text[:k]) for k in range(len(text) + 1)]
        assert list(own.prefixes(text)) == want and own.tokens(text) == want[-1]
        for limit in (0, 1, 3, 7, 12):
            assert own.fitting(text, limit) == (want[-1], max(k for k, x in enumerate(want) if x <= limit))


def test_tables_answer_truncation_and_budgets(spark, n):
    text = "The quick brown fox isn't  there.\n\n  <|endoftext|> Größe ½ x"
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, None, 9)], "doc_id long, text string, prefix_tokens int")
    table = token_counts.prefix_tokens(docs, PATH)
    got = table.select("doc_id", token_counts.tokens_within(20).alias("cut"), token_counts.longest_prefix(7).alias("fit"), token_counts.tokens_within(10**6).alias("all")).orderBy("doc_id").collect()
    fit = max(k for k in range(len(text) + 1) if n(text[:k]) <= 7)
    assert [tuple(r) for r in got] == [(1, n(text[:20]), fit, n(text))] * 2 + [(2, 0, 0, 0)]


def test_counts_of_odd_texts(spark, n):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    rows = {r["doc_id"]: r for r in token_counts.counts(docs, PATH, 100).collect()}
    for k, text in enumerate(ODD):
        text = text or ""
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len(text.encode()), n(text), n(text) > 100)
        assert n(text[: rows[k]["fit_chars"]]) <= 100 and (rows[k]["over_limit"] or rows[k]["fit_chars"] == len(text))
    assert token_counts.counts(docs.where("doc_id < 0"), PATH).count() == 0
    assert token_counts.counts(docs.select(F.lit("x").alias("doc_id"), "text"), PATH).schema["doc_id"].dataType.simpleString() == "string"


def test_another_kind_of_vocabulary_is_an_error():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))


def test_query_is_the_library(spark, n):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = q.op11_token_counts(spark, d).collect()
    assert len(rows) == len(texts)
    assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n(texts[r["doc_id"]]), n(texts[r["doc_id"]]) > 1024) for r in rows)
