"""Landed items kept by a stream, against the same log taken as a whole."""

import json
import random
from datetime import datetime, timedelta

import pytest

from tests import build
from wayloom.session import fresh_dir
from wayloom.sources.items import items_from_fetches
from wayloom.streaming import landing


def responses(seed, size):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for i in range(size):
        kind = rng.choice(["good", "good", "gone", "failed", "bad"])
        status = {"good": 200, "gone": 404, "failed": 503, "bad": 200}[kind]
        path = f"/p{rng.randint(0, 25)}"
        body = json.dumps({"base_path": path, "title": f"t{i}", "links": {"related": [{"base_path": f"/p{i}"}]}}) if kind == "good" else "{bad"
        rows.append((i, "c", path, start + timedelta(minutes=rng.randint(0, 40)), status, body, None))
    return rows


def run(spark, source, target, **options):
    landing.start_landing(landing.read_fetches(spark, source, 1), target, **options).awaitTermination()


def content(frame):
    return sorted((r.requested_path, r.base_path, r.title, r.error, str(r.links)) for r in frame.collect())


@pytest.mark.parametrize("batches, merge_every", [(1, 16), (7, 3), (5, 16)])
def test_any_split_into_batches(spark, batches, merge_every):
    rows, source, target = responses(batches, 150), fresh_dir(spark, "log"), fresh_dir(spark, "landed")
    random.Random(1).shuffle(rows)
    for i in range(batches):
        build.fetches(spark, rows[i::batches]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, target, merge_every=merge_every)
    found = landing.landed_items(spark, target)
    assert found.columns == items_from_fetches(build.fetches(spark, rows)).columns
    assert content(found) == content(items_from_fetches(build.fetches(spark, rows)))
    folders = landing._in_use(landing._marks(spark, target))
    assert sum(mark.merged for mark in folders) == (merge_every == 3) and len(folders) <= max(merge_every, batches)


def test_more_logs_after_a_restart(spark):
    source, target = fresh_dir(spark, "log"), fresh_dir(spark, "landed")
    assert landing.landed_items(spark, target).count() == 0
    so_far = []
    for seed in (1, 2, 3):
        more = [(r[0] + 1000 * seed, *r[1:]) for r in responses(seed, 40)]
        so_far += more
        build.fetches(spark, more).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, target, merge_every=2)
        assert content(landing.landed_items(spark, target)) == content(items_from_fetches(build.fetches(spark, so_far)))


def test_a_folder_without_its_mark_does_not_count(spark):
    source, target = fresh_dir(spark, "log"), fresh_dir(spark, "landed")
    rows = responses(5, 60)
    build.fetches(spark, rows).coalesce(1).write.parquet(source)
    run(spark, source, target)
    torn = landing.landed_items(spark, target).selectExpr("*", "timestamp'2030-01-01' AS fetched_at", "1L AS request_id")
    torn.write.parquet(f"{target}/answers/batch=1")
    assert content(landing.landed_items(spark, target)) == content(items_from_fetches(build.fetches(spark, rows)))
    with pytest.raises(ValueError):
        landing.start_landing(landing.read_fetches(spark, source), target, merge_every=1)
