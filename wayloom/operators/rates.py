"""Request-rate audit of a fetch log (K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.times import floor_div

RATE_LIMIT = 10
WINDOW_MICROS = 1_000_000
SLICE_MICROS = 10_000_000


def rate_audit(
    fetch_log: DataFrame,
    limit: int = RATE_LIMIT,
    window_micros: int = WINDOW_MICROS,
    slice_micros: int = SLICE_MICROS,
) -> DataFrame:
    """client, request_id, n_window, over_limit for each request.

    ``n_window`` counts the client's requests not older than ``window_micros``, the request
    itself and others at the same instant included. Each request adds 1 at its time and
    takes 1 away when it leaves the window, so the count is a running sum. The sum runs
    within slices of time that start from the client's total before them. A slice holds
    one row per instant, at most ``slice_micros`` of them, however busy the client is.
    """
    requests = fetch_log.select("client", "request_id", F.unix_micros("fetched_at").alias("at"))
    steps = F.inline(
        F.array(
            F.struct(F.col("at"), F.lit(1).alias("step")),
            F.struct((F.col("at") + window_micros).alias("at"), F.lit(-1).alias("step")),
        )
    )
    changes = (
        requests.select("client", steps)
        .groupBy("client", "at", floor_div(F.col("at"), slice_micros).alias("slice"))
        .agg(F.sum("step").alias("change"))
    )
    earlier = Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        changes.groupBy("client", "slice")
        .agg(F.sum("change").alias("change"))
        .select("client", "slice", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("start"))
    )
    running = Window.partitionBy("client", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = changes.join(starts, ["client", "slice"]).select(
        "client", "at", (F.col("start") + F.sum("change").over(running)).alias("n_window")
    )
    return requests.join(counts, ["client", "at"]).select(
        "client", "request_id", "n_window", (F.col("n_window") > limit).alias("over_limit")
    )
