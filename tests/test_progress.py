"""A7, P15, T1 to T3."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import build
from wayloom.operators import progress
from wayloom.session import fresh_dir
from wayloom.sources import testdata
from wayloom.streaming import progress as live

START = datetime(2024, 1, 1)


def events(spark, *changes):
    """One event per change, one second apart."""
    names = ("section", "section_started", "links_found", "depth", "content_type", "rate_limited")
    return build.events(spark, [
        (i, START + timedelta(seconds=i), *(change.get(name) for name in names)) for i, change in enumerate(changes)])


def test_counters(spark):
    frame = events(
        spark,
        {"section": "s1", "section_started": True, "links_found": 5, "depth": 1, "content_type": "guide"},
        {"section": "s1", "links_found": 3, "depth": 1, "content_type": "guide", "rate_limited": True},
        {"section": "s2", "section_started": True, "depth": 2, "content_type": "detailed_guide"},
        {"rate_limited": True},
    )
    status = progress.scan_progress(frame).first()
    assert tuple(status) == (2, 8, 2, "s2", "0:00:03")
    assert build.rows(progress.progress_by_depth(frame)) == [(1, 2), (2, 1)]
    assert build.rows(progress.progress_by_type(frame)) == [("detailed_guide", 1), ("guide", 2)]


def test_no_events(spark):
    assert tuple(progress.scan_progress(events(spark, {}).limit(0)).first()) == (0, 0, 0, "", "0:00:00")


def test_a_section_counts_each_time_it_starts(spark):
    frame = events(spark, *({"section": "s", "section_started": True} for _ in range(3)))
    assert progress.scan_progress(frame).first().sections_analyzed == 3


def test_heartbeat_renews_the_counters(spark, sf_dir):
    source, target = fresh_dir(spark, "events"), fresh_dir(spark, "progress")
    batch = testdata.page_events(spark, sf_dir)
    batch.write.parquet(source)
    query = live.start_progress(live.read_page_events(spark, source), target, heartbeat="1 second")
    try:
        query.processAllAvailable()
        status = progress.status_from_cells(live.latest_cells(spark, target)).first()
    finally:
        query.stop()
    assert tuple(status) == tuple(progress.scan_progress(batch).first())


def test_reader_during_a_write_sees_the_last_whole_trigger(spark, sf_dir):
    target = fresh_dir(spark, "progress")
    with pytest.raises(ValueError):
        live.latest_cells(spark, target)
    cells = progress.live_cells(testdata.page_events(spark, sf_dir))
    cells.write.parquet(f"{target}/cells/batch=0")
    spark.range(1).selectExpr("true AS ended").write.parquet(f"{target}/ends/batch=0")
    # The next trigger has written some of its files, but not its mark.
    cells.limit(1).write.parquet(f"{target}/cells/batch=1")
    assert build.rows(live.latest_cells(spark, target)) == build.rows(cells)


def test_stream_equals_batch(spark, sf_dir):
    source, target = fresh_dir(spark, "events"), fresh_dir(spark, "progress")
    batch = testdata.page_events(spark, sf_dir)
    batch.repartition(3).write.parquet(source)
    first = live.start_progress(live.read_page_events(spark, source, 1), target, heartbeat=None)
    first.awaitTermination()
    assert build.rows(progress.metrics_from_cells(live.latest_cells(spark, target))) == build.rows(
        progress.metrics_from_cells(progress.live_cells(batch)))
    # More events arrive; a restarted stream goes on from its saved state.
    more = batch.limit(50).cache()
    more.write.mode("append").parquet(source)
    live.start_progress(live.read_page_events(spark, source), target, heartbeat=None).awaitTermination()
    assert build.rows(progress.metrics_from_cells(live.latest_cells(spark, target))) == build.rows(
        progress.metrics_from_cells(progress.live_cells(batch.unionByName(more))))
    more.unpersist()


def test_different_sections_after_a_restart(spark):
    """Late and repeated events of a section don't count it twice."""
    def at(day, *names):
        frame = events(spark, *({"section": name, "links_found": 1} for name in names))
        return frame.withColumn("event_time", F.lit(datetime(2024, 1, day)).cast("timestamp"))

    source, target = fresh_dir(spark, "events"), fresh_dir(spark, "progress")
    for frame, covered in ((at(5, "a", "b", "a", None), 2), (at(1, "b", "c", "c"), 3), (at(9, "a"), 3)):
        frame.write.mode("append").parquet(source)
        live.start_progress(live.read_page_events(spark, source), target, heartbeat=None).awaitTermination()
        cells = live.latest_cells(spark, target)
        counted = {r.metric: r.n for r in progress.metrics_from_cells(cells).collect()}
        assert counted["sections_covered"] == covered
        assert progress.status_from_cells(cells).first().total_links_found == spark.read.parquet(source).count()
