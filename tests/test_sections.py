"""A10, A12, F4, F7, J4, P8 and the frontier: J5, K5, K6, K7."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests import build
from wayloom.operators import frontier, rates, ranking, sections

CATALOGUE = [(0, "Museums", "/browse/museums"), (1, "Parks", "/browse/parks")]


def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "ord INT, title STRING, path STRING")


def test_catalogue(spark):
    frame = build.items(spark, [
        build.item("/browse", links={"children": [("Museums", "/browse/museums"), (None, "/x"),
                                                  ("Parks", "/browse/parks")]}),
        build.item("/other", links={"children": [("No", "/no")]}),
    ])
    found = sections.section_catalogue(frame)
    assert [(title, path) for _, title, path in build.rows(found)] == [row[1:] for row in CATALOGUE]
    assert sections.require_sections(found) is found
    empty = sections.section_catalogue(build.items(spark, [build.item("/browse")]))
    with pytest.raises(sections.NoSectionsError):
        sections.require_sections(empty)


def test_select_sections(spark):
    frame = catalogue(spark)
    assert sections.select_sections(frame, None) is frame
    assert build.rows(sections.select_sections(frame, " Museums , /browse/parks")) == CATALOGUE
    assert build.rows(sections.select_sections(frame, "Parks,nothing")) == CATALOGUE[1:]
    with pytest.raises(sections.NoSectionsError):
        sections.select_sections(frame, "Harbours")


def test_section_priority(spark):
    assert build.rows(sections.prioritise_sections(catalogue(spark), ["Parks"])) == [
        ("/browse/museums", 10), ("/browse/parks", 1)]
    assert {r.priority for r in sections.prioritise_sections(catalogue(spark), []).collect()} == {10}


def test_section_sample(spark):
    frame = build.items(spark, [
        build.item("/browse/museums", document_type="browse_page",
                   links={"children": [("One", "/1"), ("Two", "/2"), (None, "/3")]}),
    ])
    assert build.rows(sections.section_sample(catalogue(spark), frame)) == [
        ("Museums", "/browse/museums", 2, "browse_page"), ("Parks", "/browse/parks", 0, None)]
    assert build.rows(sections.section_children(catalogue(spark), frame)) == [
        ("/browse/museums", "Museums", 0, "One", "/1"), ("/browse/museums", "Museums", 1, "Two", "/2")]


def test_new_links_come_once(spark):
    paths = lambda *names: spark.createDataFrame([(name,) for name in names], "path STRING")
    assert build.rows(frontier.new_links(paths("/a", "/a", "/b", "/c"), paths("/b", "/z"))) == [("/a",), ("/c",)]


def queue(spark, entries):
    return spark.createDataFrame(entries, "section STRING, path STRING, depth INT, priority INT")


def test_next_batch(spark):
    rows = [("/s", f"/p{i}", 1, i % 3 + 1) for i in range(25)]
    batch = frontier.next_batch(queue(spark, rows), 4).collect()
    assert [r.path for r in batch] == [r[1] for r in sorted(rows, key=lambda r: (r[3], r[1], r[2]))[:4]]
    assert frontier.next_batch(queue(spark, rows)).count() == 10
    assert frontier.next_batch(queue(spark, [])).count() == 0


def test_batches_with_one_hot_section(spark):
    rng = random.Random(5)
    rows = [("/hot" if i % 3 else f"/s{i % 7}", f"/p{i}", i % 4, rng.choice([1, 1, 1, 20])) for i in range(600)]
    expected = {}
    for section in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == section), key=lambda r: (r[3], r[1], r[2]))
        expected |= {r[1]: place // 7 for place, r in enumerate(ordered)}
    found = frontier.frontier_batches(queue(spark, rows), 7)
    assert {r.path: r.batch for r in found.collect()} == expected


def test_hot_group_is_numbered_in_several_ranges(spark):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("'one' AS g", "id")
    numbered = ranking.number_rows(rows, ["g"], ["id"], "place")
    assert numbered.filter("place <> id + 1").count() == 0 and numbered.count() == 20_000


def test_numbers_follow_from_the_sorted_ranges(spark):
    """Rows are shuffled and sorted before they are written; what reads them again does neither."""
    rows = spark.range(0, 3_000, 1, 4).selectExpr("CAST(id % 3 AS STRING) AS g", "id DIV 3 AS k")
    numbered = ranking.number_rows(rows, ["g"], ["k"], "place")
    assert numbered.filter("place <> k + 1").count() == 0 and numbered.count() == 3_000
    assert "row_number" not in numbered._jdf.queryExecution().optimizedPlan().toString()


def test_many_links_meet_the_pages_in_more_partitions(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [f"/n{i}" for i in range(30)]
    to = {node: rng.sample(nodes, 4) + ["/assets/x.pdf", "/missing"] for node in nodes}
    items = build.items(spark, [build.item(node, to[node]) for node in nodes] + [build.item("/n1", requested="/old")])
    depths = {node: rng.randrange(4) for node in nodes[:20]}
    table = spark.createDataFrame(list(depths.items()), "path STRING, depth_level INT")
    expected = {(depth, dst) for src, depth in depths.items() for dst in to[src] if dst in to and depths.get(dst, 9) > depth}
    usual = frontier.links_beyond(items, table)
    monkeypatch.setattr(frontier, "PART_LINKS", 20)
    split = frontier.links_beyond(items, table)
    assert build.rows(usual) == build.rows(split) == sorted(expected, key=repr)
    # 181 entries, 20 to a partition; below that the session's partitions stay.
    assert "RepartitionByExpression" in str(split._jdf.queryExecution().optimizedPlan().toString())
    assert "RepartitionByExpression" not in str(usual._jdf.queryExecution().optimizedPlan().toString())


START = datetime(2024, 1, 1)


def log(spark, requests):
    return build.fetches(spark, [
        (i, client, "/x", START + timedelta(microseconds=at), 200, "{}", None) for i, (client, at) in enumerate(requests)])


def brute_force(requests, window):
    return {i: sum(1 for c, t in requests if c == client and at - window < t <= at)
            for i, (client, at) in enumerate(requests)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    requests=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=25),
    window=st.sampled_from([1, 5, 40]),
    size=st.sampled_from([1, 7, 1000]),
)
def test_rate_audit_against_brute_force(spark, requests, window, size):
    found = rates.rate_audit(log(spark, requests), limit=2, window_micros=window, slice_micros=size).collect()
    expected = brute_force(requests, window)
    assert {r.request_id: r.n_window for r in found} == expected
    assert all(r.over_limit == (r.n_window > 2) for r in found)


def test_rate_window_edge(spark):
    """A request counts while it is younger than one second."""
    requests = [("c", 0), ("c", 999_999), ("c", 1_000_000)] + [("d", 5)] * 11
    found = {r.request_id: (r.n_window, r.over_limit) for r in rates.rate_audit(log(spark, requests)).collect()}
    assert [found[i] for i in range(4)] == [(1, False), (2, False), (2, False), (11, True)]
