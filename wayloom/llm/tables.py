"""The tables these operators read, and the written tables that cut a long plan."""

from __future__ import annotations

import ctypes
import gc
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.session import fresh_dir

MAX_ROWS = 1000

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "benchmark":  # item_id is text or a number
        found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return found.withColumn("item_id", F.col("item_id").cast("string"))
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that later steps start from files."""
    spark = frame.sparkSession
    path = fresh_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def long_texts(frame: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends at most a thousand of them to Python at a
    time, as texts may be long and a task's memory holds a few batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = frame.sparkSession
    if not 0 < int(spark.conf.get(name)) <= MAX_ROWS:
        spark.conf.set(name, str(MAX_ROWS))
    return frame


@cache
def _trim():
    """What gives free memory of the C library back to the system, where there is such a call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda kept: 0


def give_back() -> None:
    """Free memory goes back to the system at the end of a task; the worker process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)
