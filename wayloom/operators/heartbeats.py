"""Heartbeats of a scan: a sign of life at the first event a minute after the last one.

Which event is a heartbeat hangs on the one before, back to the first event. So every moment
gets a pointer to the first moment over a minute later, and pointers are doubled: a round knows
the heartbeats of twice as many steps, and n of them take log2(n) rounds of joins by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.times import duration_text
from wayloom.operators.ranking import number_rows
from wayloom.session import stored

EVERY_MICROS = 60_000_000


def heartbeats(events: DataFrame, *, every_micros: int = EVERY_MICROS) -> DataFrame:
    """beat (from 1), event_time, event_id, elapsed: one row per heartbeat.

    The clock starts at the first event, which is none itself; a heartbeat is the first event
    more than ``every_micros`` after the start or the heartbeat before. Of events at one moment
    the smallest id stands; events without a time are left out.
    """
    if every_micros < 0:
        raise ValueError("every_micros must not be negative")
    moments = (
        events.filter("event_time IS NOT NULL").groupBy("event_time").agg(F.min("event_id").alias("event_id"))
        .withColumn("all", F.lit(0))
    )
    moments = stored(number_rows(moments, ["all"], ["event_time"], "number").drop("all"), "moments")
    steps = _steps(stored(_pointers(moments, every_micros), "pointers"))
    start = moments.filter("number = 1").first()
    elapsed = F.unix_micros("event_time") - F.unix_micros(F.lit(start["event_time"] if start else None).cast("timestamp"))
    return moments.join(steps, "number").select("beat", "event_time", "event_id", duration_text(elapsed).alias("elapsed"))


def _pointers(moments: DataFrame, every_micros: int) -> DataFrame:
    """number, to: for each moment the first one over ``every_micros`` later.

    Moments and the ends of their waits are numbered together. The i-th end stands after i - 1
    others, so its place less i is the number of moments up to it.
    """
    at = F.unix_micros("event_time")
    ends = moments.select(F.lit(0).alias("all"), (at + every_micros).alias("at"), F.lit(1).alias("is_end"), "number")
    starts = moments.select(F.lit(0).alias("all"), at.alias("at"), F.lit(0).alias("is_end"), "number")
    placed = number_rows(starts.unionAll(ends), ["all"], ["at", "is_end"], "place")
    after = placed.filter("is_end = 1").select("number", (F.col("place") - F.col("number") + 1).alias("to"))
    return after.join(moments.select(F.col("number").alias("to")), "to", "left_semi").select("number", "to")


def _steps(jumps: DataFrame) -> DataFrame:
    """number, beat of the moments that lie one, two, … steps after the first."""
    spark, stride = jumps.sparkSession, 1
    found = spark.createDataFrame([(1, 0)], "number BIGINT, beat BIGINT")
    while True:
        further = stored(found.join(jumps, "number").select(F.col("to").alias("number"), F.col("beat") + stride), "beats")
        if further.isEmpty():
            return found.toDF("number", "beat").filter("beat > 0")
        found = found.unionAll(further)
        twice = jumps.select(F.col("number").alias("to"), F.col("to").alias("further"))
        jumps = stored(jumps.join(twice, "to").select("number", F.col("further").alias("to")), "pointers")
        stride *= 2
