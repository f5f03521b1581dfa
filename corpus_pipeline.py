"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each stage's result to the shared folder and reads it back.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import bpe, jaccard, langid, mixing, pii
from tickweave.llm.common import staged, table
from tickweave.llm.queries import PII_KEY, topic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Powers that flatten the token shares of a dimension, and the part of all tokens to draw.
SHARES, PART = {"source": 0.7, "lang": 0.7, "topic": 0.8}, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; ``lang`` of the others is the predicted one."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a word 5-gram Jaccard of 0.8, the one with the least id stays.

    Rows are told apart by id and text: a repeated or null id loses no text.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in ``text``; n_chars follows."""
    return pii.replace(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to flattened source, language and topic shares."""
    return mixing.sample(docs.select(*COLUMNS).withColumn("topic", topic()), SHARES, PART).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("PII", surrogates),
    ("mixing", mixture),
    ("BPE", encoding),
]

#: SQL cannot state learned filters or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
