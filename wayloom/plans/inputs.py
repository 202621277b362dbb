"""Tables shared by the registered queries, built once per session and state of the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.plans.scan import scan
from wayloom.sources import testdata

AS_OF = "2024-02-01 00:00:00"
MAX_DEPTH = 5

_scans: dict[tuple[str, str, str], dict[str, DataFrame]] = {}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.content_items(spark, sf_dir)


def site(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables of the scan of every section; catalogue and pages are stored on first use,
    and again when a file of the folder has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, _listing(spark, sf_dir))
    if key not in _scans:
        _scans[key] = scan(
            items(spark, sf_dir), as_of=AS_OF, max_depth=MAX_DEPTH, detail="detailed",
            fetch_log=testdata.fetch_log(spark, sf_dir),
        )
    return _scans[key]


def _listing(spark: SparkSession, sf_dir: str) -> str:
    """A mark of the folder's files, their sizes and times; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sf_dir)
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("x")).first()
    return f"{row['n']}:{row['x']}"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site(spark, sf_dir)["pages"]


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site(spark, sf_dir)["catalogue"]


def event_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = testdata.event_pages(spark, sf_dir).select("section").distinct()
    return names.select(
        F.col("section").cast("int").alias("ord"),
        F.concat(F.lit("Section "), "section").alias("title"),
        F.col("section").alias("path"),
    )
