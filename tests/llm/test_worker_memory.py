"""Python workers, which Spark keeps, hold nothing of the operators whose tasks are through."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tickweave.llm import bpe, jaccard, langid


def kept(spark) -> tuple[int, int]:
    """The most words and encoders that a worker holds."""

    def look(batches):
        from tickweave.llm import bpe, shingles

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles._KNOWN)]), pa.array([len(bpe._MADE)])], names=["words", "encoders"])

    return tuple(spark.range(0, 8, 1, 8).mapInArrow(look, "words long, encoders long").agg(F.max("words"), F.max("encoders")).first())


def test_workers_hold_no_caches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8)
    bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).write.format("noop").mode("overwrite").save()
    assert kept(spark)[1] == 1  # its own tasks share it
    jaccard.keep_one(docs).write.format("noop").mode("overwrite").save()
    langid.keep_identified(docs, langid.learn(docs)).write.format("noop").mode("overwrite").save()
    assert kept(spark) == (0, 0)
