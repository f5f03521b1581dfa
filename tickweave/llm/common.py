"""What the corpus operators share: tables, staged results, Arrow batch size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.staging import shared_dir, staged  # noqa: F401

#: Whole texts travel in Arrow batches of at most so many rows, and about so many bytes.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that one Arrow batch hands to Python (settings of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def parts(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: What a Python worker keeps from task to task: operator -> how to let go of it.
CACHES: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    """Empties what operators other than ``but`` keep in this process, and gives free memory back to the system."""
    for name in [n for n in CACHES if n != but]:
        CACHES[name]()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable, own: str = "") -> Callable:
    """``run`` for mapInArrow, in a worker that holds nothing before and after but what ``own`` keeps.

    Spark keeps idle workers, and their memory counts beside that of the stages that follow.
    """

    def task(batches):
        let_go(own)
        yield from run(batches)
        let_go(own)

    return task
