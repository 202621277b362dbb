"""Live progress counters with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from wayloom.operators.progress import live_cells
from wayloom.schemas import PAGE_EVENTS

HEARTBEAT = "60 seconds"


def read_page_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_progress(events: DataFrame, path: str, *, heartbeat: str | None = HEARTBEAT) -> StreamingQuery:
    """Keep the cells of all events so far in ``path``, renewed at every heartbeat.

    Each trigger writes its own ``cells/batch=n`` folder, so a repeated trigger replaces
    its own output only, and an end mark ``ends/batch=n`` once the cells are whole. State has one row per content type and depth, so it needs no
    watermark. Without a ``heartbeat`` the query takes what is there and ends.
    """

    def write(cells: DataFrame, batch: int) -> None:
        if batch in _ended(cells.sparkSession, path):
            return  # a trigger that ended and is told to run again has the same cells
        cells.write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")
        cells.sparkSession.range(1).selectExpr("true AS ended").write.mode("overwrite").parquet(f"{path}/ends/batch={batch}")

    writer = (
        live_cells(events)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
    )
    trigger = {"processingTime": heartbeat} if heartbeat else {"availableNow": True}
    return writer.trigger(**trigger).start()


def latest_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the last trigger that has its end mark; cells of others aren't listed."""
    ended = _ended(spark, path)
    if not ended:
        raise ValueError(f"no trigger has ended in {path}")
    return spark.read.parquet(f"{path}/cells/batch={max(ended)}")


def _ended(spark: SparkSession, path: str) -> set[int]:
    """Triggers that wrote their end mark; one short row each."""
    try:
        marks = spark.read.schema("ended BOOLEAN, batch INT").parquet(f"{path}/ends")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return set()
        raise
    return {row.batch for row in marks.select("batch").distinct().collect()}
