"""Landed items kept up to date from arriving fetch logs (S1, S2 as a stream).

Each trigger parses the bodies of its own responses once and writes the last answer to each
path as a folder of its own, by buckets of the path. What counts over all triggers follows from
the keys alone: path, time, request and folder. From time to time the folders are merged into
one, bucket by bucket, so their number stays small and old answers go.

A trigger that is repeated writes the same folder again; a folder counts once its end mark is
there, and a merged one takes the place of those before it with its own mark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wayloom.schemas import CONTENT_ITEMS, FETCH_LOG
from wayloom.sources.items import answers

MERGE_EVERY = 16
ANSWERS = f"{CONTENT_ITEMS}, fetched_at TIMESTAMP, request_id BIGINT"
MARKS = "upto INT, merged BOOLEAN, batch INT"


def read_fetches(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FETCH_LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_landing(fetches: DataFrame, path: str, *, every: str | None = None, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Keep the last good or not-found answer to each path below ``path``.

    Answers may come in any order and in any batches. With ``every`` a trigger runs at that
    interval, without it the query takes what is there and ends. After ``merge_every`` triggers
    their folders become one. One query may write to ``path`` at a time.
    """
    if merge_every < 2:
        raise ValueError("merge_every must be at least 2")

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _marks(spark, path)
        if any(number <= mark.upto for mark in marks if mark.merged):
            return  # a trigger that ended, was merged, and is told to run again
        staged = f"{path}/parsed/batch={number}"
        answers(batch).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
        parsed = spark.read.schema(f"{ANSWERS}, row BIGINT").parquet(staged)
        _write(_last(parsed, "row"), path, f"batch={number}")
        _mark(spark, path, number, False)
        if sum(1 for mark in _in_use(marks) if not mark.merged and mark.batch != number) + 1 >= merge_every:
            _write(_landed(spark, path), path, f"merged={number}")
            _mark(spark, path, number, True)

    writer = fetches.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(land)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def landed_items(spark: SparkSession, path: str) -> DataFrame:
    """The items as of the last trigger that ended, in the shape of ``CONTENT_ITEMS``."""
    return _landed(spark, path).drop("fetched_at", "request_id")


def _landed(spark: SparkSession, path: str) -> DataFrame:
    folders = _in_use(_marks(spark, path))
    if not folders:
        return spark.createDataFrame([], ANSWERS)
    found = None
    for mark in folders:
        name = f"{'merged' if mark.merged else 'batch'}={mark.batch}"
        part = spark.read.schema(ANSWERS).parquet(f"{path}/answers/{name}").withColumn("folder", F.lit(name))
        found = part if found is None else found.unionAll(part)
    # A path has one answer in a folder, so path and folder name a document.
    return _last(found, "requested_path", "folder") if len(folders) > 1 else found.drop("folder")


def _last(found: DataFrame, *names: str) -> DataFrame:
    """The last answer to each path, found by its keys; documents are neither sorted nor aggregated.

    ``names`` tell a document from all others. Equal times go by request, then by name.
    """
    order = F.struct("fetched_at", "request_id", *(name for name in names if name != "requested_path"))
    last = found.groupBy("requested_path").agg(F.max(order).alias("last"))
    chosen = last.select(*("requested_path" if name == "requested_path" else f"last.{name}" for name in names))
    extra = [name for name in names if name != "requested_path"]
    return found.join(chosen.hint("shuffle_hash"), list(names), "left_semi").drop(*extra)


def _write(rows: DataFrame, path: str, name: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/answers/{name}")


def _mark(spark: SparkSession, path: str, number: int, merged: bool) -> None:
    mark = spark.range(1).select(F.lit(number).alias("upto"), F.lit(merged).alias("merged"))
    mark.write.mode("overwrite").parquet(f"{path}/marks/kind={'merged' if merged else 'batch'}/batch={number}")


def _marks(spark: SparkSession, path: str) -> list:
    """End marks, one short row per trigger; none before the first."""
    try:
        return spark.read.schema(f"{MARKS}, kind STRING").parquet(f"{path}/marks").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _in_use(marks: list) -> list:
    """The last merged folder and the triggers after it."""
    last = max((mark.batch for mark in marks if mark.merged), default=-1)
    merged = [mark for mark in marks if mark.merged and mark.batch == last]
    return merged + sorted((mark for mark in marks if not mark.merged and mark.batch > last), key=lambda mark: mark.batch)
