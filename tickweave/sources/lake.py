"""A lake of message logs: text landed once as typed Parquet, read with partition pruning.

``land`` runs a file stream to its end: Spark's checkpoint remembers which files were
taken, so each file is read as text once, whenever it appears below
``<root>/<date>/<product>/<message type>``. A trigger's rows go to partitions
(session_date, product, message_type, batch); a trigger that is run again after a failure
replaces its own partitions and no others.

Files of different columns may lie side by side: the first line of each names its own.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.schemas import MESSAGE_TYPES
from tickweave.sources.messages import clocked, message_schema, ranked, typed

#: Files taken in one trigger; their names pass the driver.
FILES = 2000
FOLDER = ["session_date", "product", "message_type"]
NAMES = "path string, modificationTime timestamp, length long, content binary"


def lake_schema() -> T.StructType:
    """The lake's columns; partition columns are strings, whatever they look like."""
    extra = [T.StructField("_file", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_id", T.LongType())]
    return T.StructType([*message_schema().fields, *extra, *[T.StructField(c, T.StringType()) for c in FOLDER], T.StructField("batch", T.LongType())])


def header(spark: SparkSession, path: str) -> str:
    """The first line of a text file on any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    raw = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_files(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame | None:
    """Rows of the files, typed, with their folder and place; one scan for all files of the same columns."""
    if fmt != "csv":
        raws = [spark.read.format(fmt).option("mergeSchema", True).load(paths)] if paths else []
    else:
        with ThreadPoolExecutor(16) as pool:
            firsts = list(pool.map(lambda p: header(spark, p), paths))
        alike = defaultdict(list)
        for path, first in zip(paths, firsts, strict=True):
            if first.strip():  # an empty file has no columns and no rows
                alike[first].append(path)
        raws = []
        for first, some in alike.items():
            names = [c.strip().strip('"') for c in first.split(",")]
            schema = T.StructType([T.StructField(n or f"_{k}", T.StringType()) for k, n in enumerate(names)])
            raws.append(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(some))
    frames = []
    for raw in raws:
        place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
        folder = [F.regexp_extract("_metadata.file_path", "([^/]+)/([^/]+)/([^/]+)/[^/]+$", k + 1).alias(c) for k, c in enumerate(FOLDER)]
        frames.append(typed(raw.select("*", *place, *folder), ["_file", "_start", "_id", *FOLDER]))
    return reduce(DataFrame.unionByName, frames) if frames else None


def land(spark: SparkSession, root: str, lake: str, state: str, folders: list[str] | None = None, fmt: str = "csv") -> list[dict]:
    """Take all files below ``root`` that are not in the lake yet; ``state`` is the stream's checkpoint.

    ``folders``: only these ``<date>/<product>``. Returns the stream's progress, one entry a trigger.
    """
    some = f"{{{','.join(sorted(set(folders)))}}}" if folders else "*/*"
    names = spark.readStream.format("binaryFile").schema(NAMES).option("maxFilesPerTrigger", FILES).load(f"{root}/{some}/*").select("path")

    def take(batch: DataFrame, number: int) -> None:
        rows = read_files(spark, sorted(r["path"] for r in batch.collect()), fmt)  # names of FILES files
        if rows is not None:
            (rows.where(F.col("message_type").isin(list(MESSAGE_TYPES))).withColumn("batch", F.lit(number))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER, "batch").parquet(lake))

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lake)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    query = names.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p for p in map(dict, query.recentProgress) if p["numInputRows"]]


def pruned(spark: SparkSession, lake: str, dates: list[str] | None = None, products: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """The lake's rows of some partitions; the conditions are met by file listing."""
    out = spark.read.schema(lake_schema()).parquet(lake)
    for column, values in zip(FOLDER, (dates, products, types), strict=True):
        if values is not None:
            out = out.where(F.col(column).isin(sorted(set(values))))
    return out


def read(spark: SparkSession, lake: str, dates: list[str] | None = None, products: list[str] | None = None, types: list[str] | None = None, clock: str = "receipt") -> DataFrame:
    """Messages with session_date, product, message_type, ts_ns, ts, arrival."""
    return clocked(ranked(pruned(spark, lake, dates, products, types), FOLDER), clock).drop("batch")


def failures(spark: SparkSession, lake: str, expected: list[tuple[str, str, str]]) -> DataFrame:
    """session_date, product, message_type, reason of what was expected and is not there: a row each."""
    asked = spark.createDataFrame(expected, "session_date string, product string, message_type string")
    there = pruned(spark, lake, *[[e[k] for e in expected] for k in range(3)]).select(*FOLDER).distinct()
    return asked.join(there, FOLDER, "left_anti").withColumn("reason", F.lit("no rows"))
