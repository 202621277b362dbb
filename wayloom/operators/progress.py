"""Progress counters over page events.

The counters come from one small table of cells, one row per content type and depth. A
stream keeps the same cells as its state, so batch and live figures share one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.times import duration_text


def progress_cells(events: DataFrame) -> DataFrame:
    """Counters per content type and depth; works on a batch and on a stream.

    All counters have a fixed width, so Spark aggregates them by hash, without a sort.
    """
    return events.groupBy("content_type", "depth").agg(*_counters())


def live_cells(events: DataFrame) -> DataFrame:
    """The cells, each with its ``latest`` event, and one row per section met so far.

    A section's row has ``met`` and no type or depth. However often and late its events come,
    it is one row, so the number of sections is exact.
    """
    kind = "STRUCT<content_type: STRING, depth: INT, met: STRING, counts: BOOLEAN>"
    as_cell = F.struct("content_type", "depth", F.lit(None).cast("string"), F.lit(True)).cast(kind)
    as_section = F.struct(F.lit(None).cast("string"), F.lit(None).cast("int"), "section", F.lit(False)).cast(kind)
    facts = [c for c in events.columns if c not in ("content_type", "depth")]
    both = events.select(*facts, F.inline(F.array(as_cell, as_section))).filter("counts OR met IS NOT NULL")
    latest = F.max(F.when(F.col("section").isNotNull(), F.struct("event_time", "event_id", "section")))
    return both.groupBy("content_type", "depth", "met", "counts").agg(*_counters(), latest.alias("latest"))


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pages"),
        F.sum("links_found").alias("links"),
        F.count_if("rate_limited").alias("rate_limit_hits"),
        F.count_if("section_started").alias("sections"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    ]


def _with_latest(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Batch cells and one more row that holds the latest event only."""
    newest = (
        events.filter(F.col("section").isNotNull())
        .select("event_time", "event_id", "section")
        .orderBy(F.desc("event_time"), F.desc("event_id"))
        .limit(1)
        .select(F.struct("event_time", "event_id", "section").alias("latest"))
    )
    return cells.unionByName(newest, allowMissingColumns=True)


def _counting(cells: DataFrame) -> DataFrame:
    """Without the rows of live cells that name a section."""
    return cells.filter("counts") if "counts" in cells.columns else cells


def status_from_cells(cells: DataFrame) -> DataFrame:
    """The one status row: sections, links, rate-limit hits, current section, duration."""
    cells = _counting(cells)
    elapsed = F.unix_micros("last_time") - F.unix_micros("first_time")
    return cells.agg(
        F.coalesce(F.sum("sections"), F.lit(0)).alias("sections_analyzed"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("total_links_found"),
        F.coalesce(F.sum("rate_limit_hits"), F.lit(0)).alias("rate_limit_hits"),
        F.coalesce(F.max("latest")["section"], F.lit("")).alias("current_section"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    ).select(
        "sections_analyzed", "total_links_found", "rate_limit_hits", "current_section",
        duration_text(F.coalesce(elapsed, F.lit(0))).alias("scan_duration"),
    )


def counts_from_cells(cells: DataFrame, column: str) -> DataFrame:
    """Histogram of ``content_type`` or ``depth``: column, n. Unset values do not count."""
    return _counting(cells).filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("pages").alias("n"))


def metrics_from_cells(cells: DataFrame) -> DataFrame:
    """All counters as metric, item, n rows; of live cells, the number of different sections, too."""
    status = status_from_cells(cells)
    names = ("sections_analyzed", "total_links_found", "rate_limit_hits")
    totals = status.select(
        F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.lit("").alias("item"), F.col(name).alias("n")) for name in names)))
    )
    by_type = counts_from_cells(cells, "content_type").select(F.lit("content_type").alias("metric"), F.col("content_type").alias("item"), "n")
    by_depth = counts_from_cells(cells, "depth").select(F.lit("depth").alias("metric"), F.col("depth").cast("string").alias("item"), "n")
    found = totals.unionByName(by_type).unionByName(by_depth)
    if "met" not in cells.columns:
        return found
    covered = cells.filter("NOT counts").agg(F.count("met").alias("n"))
    return found.unionByName(covered.select(F.lit("sections_covered").alias("metric"), F.lit("").alias("item"), "n"))


def scan_progress(events: DataFrame) -> DataFrame:
    return status_from_cells(_with_latest(progress_cells(events), events))


def progress_by_type(events: DataFrame) -> DataFrame:
    return counts_from_cells(progress_cells(events), "content_type")


def progress_by_depth(events: DataFrame) -> DataFrame:
    return counts_from_cells(progress_cells(events), "depth")
