"""The walk against a plain breadth-first search."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import build
from wayloom.operators import crawl as walk
from wayloom.operators import links
from wayloom.session import fresh_dir
from wayloom.sources.state import CrawlState, snapshot_due


def reach(edges, roots, max_depth):
    """(ord, path) -> least depth, one search per root."""
    follow = defaultdict(set)
    for src, dst in edges:
        follow[src].add(dst)
    found = {}
    for place, root in enumerate(roots):
        level, seen = {root}, {root}
        for depth in range(max_depth + 1):
            for path in level:
                found[place, path] = depth
            level = {dst for src in level for dst in follow[src]} - seen
            seen |= level
    return found


def owners(edges, roots, max_depth, owner):
    key = (lambda place, depth: (place, depth)) if owner == "first_section" else (lambda place, depth: (depth, place))
    best = {}
    for (place, path), depth in reach(edges, roots, max_depth).items():
        candidate = (key(place, depth), place, depth)
        best[path] = min(best.get(path, candidate), candidate)
    return sorted(((roots[place], path, depth) for path, (_, place, depth) in best.items()), key=repr)


def graph(spark, edges, nodes):
    follow = defaultdict(list)
    for src, dst in edges:
        follow[src].append(dst)
    return build.items(spark, [build.item(node, follow[node]) for node in nodes])


def test_shortest_depth(spark):
    edges = [("/A", "/B"), ("/A", "/C"), ("/B", "/C"), ("/C", "/D")]
    frame = graph(spark, edges, ["/A", "/B", "/C", "/D"])
    found = walk.crawl(frame, build.sections(spark, "/A"), max_depth=2)
    assert build.rows(found) == [("/A", "/A", 0), ("/A", "/B", 1), ("/A", "/C", 1), ("/A", "/D", 2)]


def test_filters_redirects_and_missing_items(spark):
    frame = build.items(spark, [
        build.item("/r", ["/old", "/assets/a.png", "http://elsewhere.example", "/gone", "/empty", "/r"]),
        build.item("/new", ["/leaf"], requested="/old"),
        build.item("/leaf", ["/new-is-only-an-alias-target", "/new"]),
        build.item("", requested="/empty"),
        build.item("/assets/a.png"),
    ])
    found = walk.crawl(frame, build.sections(spark, "/r", "/missing-root"))
    assert build.rows(found) == [("/r", "/leaf", 2), ("/r", "/new", 1), ("/r", "/r", 0)]
    assert build.rows(links.resolved_links(frame)) == [("/new", "/leaf"), ("/r", "/new"), ("/r", "/r")]


def test_lower_section_takes_over_a_page_found_later(spark):
    """Section 1 reaches /x first; section 0 reaches it, and all behind it, one level later."""
    edges = [("/s0", "/a"), ("/a", "/x"), ("/s1", "/x"), ("/x", "/y"), ("/y", "/z")]
    nodes = ["/s0", "/s1", "/a", "/x", "/y", "/z"]
    frame, roots = graph(spark, edges, nodes), ["/s0", "/s1"]
    first = walk.crawl(frame, build.sections(spark, *roots), max_depth=3)
    assert build.rows(first) == owners(edges, roots, 3, "first_section")
    assert ("/s0", "/x", 2) in build.rows(first) and ("/s1", "/z", 3) in build.rows(first)
    nearest = walk.crawl(frame, build.sections(spark, *roots), max_depth=3, owner="nearest")
    assert build.rows(nearest) == owners(edges, roots, 3, "nearest")


@pytest.mark.parametrize("owner", walk.OWNERS)
@pytest.mark.parametrize("bucket_rows", [walk.BUCKET_ROWS, 40])
def test_random_graphs(spark, owner, bucket_rows):
    """Small ``bucket_rows`` forces the bucketed links with salted hubs."""
    rng = random.Random(7)
    nodes = [f"/n{i}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)]
    edges += [("/n5", node) for node in nodes]
    roots = ["/n1", "/n2", "/n3", "/n4"]
    for max_depth in (0, 3):
        found = walk.crawl(graph(spark, edges, nodes), build.sections(spark, *roots), max_depth=max_depth,
                           owner=owner, bucket_rows=bucket_rows)
        assert build.rows(found) == owners(edges, roots, max_depth, owner)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    edges=st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=16),
    roots=st.lists(st.integers(0, 8), min_size=1, max_size=3, unique=True),
    owner=st.sampled_from(walk.OWNERS),
)
def test_any_graph(spark, edges, roots, owner):
    name = lambda i: f"/n{i}"
    edges = [(name(a), name(b)) for a, b in edges]
    roots = [name(r) for r in roots]
    found = walk.crawl(graph(spark, edges, [name(i) for i in range(9)]), build.sections(spark, *roots), max_depth=3,
                       owner=owner)
    assert build.rows(found) == owners(edges, roots, 3, owner)


@pytest.mark.parametrize("hub", [True, False])
def test_a_level_moves_only_what_it_finds(spark, hub):
    """Links, addresses and earlier levels are read in their buckets, with and without hubs."""
    nodes = [f"/x{i}" for i in range(400)]
    rows = [build.item("/hub", nodes if hub else nodes[:5])] + [build.item(node, ["/hub"]) for node in nodes]
    store = CrawlState(spark, fresh_dir(spark, "plan"))
    staged = walk.stage_graph(build.items(spark, rows), store, bucket_rows=100)
    try:
        hubs = staged.hubs.collect()
        assert [row.src for row in hubs] == (["/hub"] if hub else []) and staged.buckets > 1
        parts = staged.edges.filter(r"src_part LIKE '/hub\n%'").select("src_part").distinct().count()
        assert parts > 1 if hub else parts == 1
        assert staged.edges.count() == (800 if hub else 405)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        levels = []
        for depth, path in enumerate(("/hub", "/x1", "/x2")):
            level = spark.createDataFrame([(path, 0, True)], "path STRING, ord INT, is_new BOOLEAN")
            levels.append(store.save_level(depth, level.repartition(staged.pages, "path"), staged.pages)[0])
        found = walk.next_level(levels, staged, True)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        # Sources to the links, targets to the addresses, pages to the levels; the rest lies still.
        assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["dst", "path", "src_part"]
        assert plan.count("Bucketed: true") == 6 and "Bucketed: false" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.release()


def test_fan_out(spark):
    frame = build.items(spark, [build.item("/root", [f"/p{i}" for i in range(87)])] +
                        [build.item(f"/p{i}") for i in range(87)])
    found = walk.crawl(frame, build.sections(spark, "/root"))
    assert found.count() == 88 and found.filter("depth_level = 1").count() == 87


def test_resume_equals_uninterrupted(spark):
    rng = random.Random(3)
    nodes = [f"/n{i}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)]
    roots = ["/n0", "/n1", "/n2"]
    frame, catalogue = graph(spark, edges, nodes), build.sections(spark, *roots)
    edges += [("/n1", node) for node in nodes]
    frame = graph(spark, edges, nodes)
    for owner in walk.OWNERS:
        state = fresh_dir(spark, "resume")
        for depth in (0, 2, 4):
            found = walk.crawl(frame, catalogue, max_depth=depth, owner=owner, state=state, snapshot_every=1,
                               bucket_rows=80)
            assert build.rows(found) == owners(edges, roots, depth, owner)
        # A shallower walk over the same state reads only its own rounds.
        assert build.rows(walk.crawl(frame, catalogue, max_depth=2, owner=owner, state=state)) == owners(
            edges, roots, 2, owner)


def test_half_written_level_is_replaced(spark):
    edges = [(f"/n{i}", f"/n{i + 1}") for i in range(4)]
    frame, catalogue = graph(spark, edges, [f"/n{i}" for i in range(5)]), build.sections(spark, "/n0")
    state = fresh_dir(spark, "torn")
    # A first run that stopped before its first snapshot leaves staged tables behind.
    torn = CrawlState(spark, state)
    torn.open()
    other = build.items(spark, [build.item("/other", ["/n0"])])
    walk.stage_graph(other, torn)
    torn.release()
    walk.crawl(frame, catalogue, max_depth=1, state=state)
    store = CrawlState(spark, state)
    store.save_level(2, spark.createDataFrame([("/junk", 0, True)], "path STRING, ord INT, is_new BOOLEAN"), 3)
    store.release()
    found = walk.crawl(frame, catalogue, max_depth=3, state=state)
    assert [row[1] for row in build.rows(found)] == ["/n0", "/n1", "/n2", "/n3"]


def test_snapshots(spark):
    frame = build.items(spark, [build.item("/root", [f"/p{i}" for i in range(61)])] +
                        [build.item(f"/p{i}") for i in range(61)])
    state = fresh_dir(spark, "snapshots")
    assert CrawlState(spark, state).snapshots() is None and CrawlState(spark, state).last_snapshot() is None
    walk.crawl(frame, build.sections(spark, "/root"), state=state, snapshot_every=17)
    last = CrawlState(spark, state).last_snapshot()
    assert last.pages_processed == 62 and last.sections_covered == 1 and last.snapshots_due == 3
    with pytest.raises(ValueError):
        walk.crawl(frame, build.sections(spark, "/root"), state=state, owner="nearest")


def test_state_of_other_inputs_is_refused(spark):
    frame = build.items(spark, [build.item("/a", ["/b"]), build.item("/b"), build.item("/c", ["/b"])])
    state = fresh_dir(spark, "other")
    walk.crawl(frame, build.sections(spark, "/a"), state=state)
    with pytest.raises(ValueError):
        walk.crawl(frame, build.sections(spark, "/c"), state=state)
    with pytest.raises(ValueError):
        walk.crawl(frame.filter("base_path <> '/b'"), build.sections(spark, "/a"), state=state)
    assert walk.crawl(frame, build.sections(spark, "/a"), state=state).count() == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("wayloom_")]


def test_repeated_rows_do_not_hide_other_items(spark):
    a, b, c = (build.item(path, ["/x"]) for path in ("/a", "/b", "/c"))
    state, roots = fresh_dir(spark, "twice"), build.sections(spark, "/c")
    walk.crawl(build.items(spark, [a, a, c]), roots, state=state)
    assert walk.crawl(build.items(spark, [a, c, a]), roots, state=state).count() == 1
    for rows in ([b, b, c], [c], [a, c]):
        with pytest.raises(ValueError):
            walk.crawl(build.items(spark, rows), roots, state=state)


def test_deep_walk(spark):
    edges = [(f"/n{i}", f"/n{i + 1}") for i in range(12)] + [("/n11", "/n0")]
    frame = graph(spark, edges, [f"/n{i}" for i in range(13)])
    found = walk.crawl(frame, build.sections(spark, "/n0"), max_depth=20)
    assert sorted(row[2] for row in build.rows(found)) == list(range(13))


def test_snapshot_cadence():
    since = 0
    due = []
    for pages in (50, 99, 100):
        due.append(snapshot_due(since, pages))
    assert due == [False, False, True]
    assert not snapshot_due(100, 150)


def test_unknown_owner(spark):
    with pytest.raises(ValueError):
        walk.crawl(build.items(spark, [build.item("/a")]), build.sections(spark, "/a"), owner="any")


def test_stored_tables_are_not_sorted_again(spark, tmp_path):
    """A level sorts what it shuffles; links, addresses and earlier levels lie sorted."""
    frame = build.items(spark, [build.item("/a", ["/b", "/c"]), build.item("/b", ["/c"]), build.item("/c")])
    store = CrawlState(spark, str(tmp_path / "walk"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = walk.stage_graph(frame, store)
        roots = build.sections(spark, "/a").selectExpr("ord", "path AS section")
        level, _, _ = store.save_level(0, walk._root_level(roots, graph.addresses), graph.pages)
        found = walk.next_level([level], graph, True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert build.rows(found) == [("/b", 0, True), ("/c", 0, True)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.release()
    assert plan.count("Sort [") == plan.count("Exchange hashpartitioning") > 0


def test_links_are_read_between_the_sources_only(spark, tmp_path):
    frame = build.items(spark, [build.item(f"/n{i}", [f"/n{i + 1}"]) for i in range(9)])
    store = CrawlState(spark, str(tmp_path / "walk"))
    try:
        graph = walk.stage_graph(frame, store, 8)
        level = frame.filter("base_path IN ('/n3', '/n5')").selectExpr("base_path AS path", "0 AS ord")
        found = walk.followed(walk.link_sources(level, graph, "ord"), graph)
        assert sorted(row["dst"] for row in found.collect()) == ["/n4", "/n6"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(src_part,/n3\n0)" in plan and "LessThanOrEqual(src_part,/n5\n0)" in plan
    finally:
        store.release()


def test_hubs_are_found_among_the_sources_of_large_cells(spark, tmp_path):
    frame = build.items(spark, [build.item("/hub", [f"/t{i}" for i in range(30)]), *(build.item(f"/s{i}", ["/hub"]) for i in range(20))])
    store = CrawlState(spark, str(tmp_path / "walk"))
    try:
        graph = walk.stage_graph(frame, store, 64)
        assert build.rows(graph.hubs) == [("/hub", 4)]
        assert graph.mark == "" and store.load("large_cells", "cell BIGINT").count() == 1
    finally:
        store.release()


def test_marks_are_exact_sums_of_hashes(spark):
    """Sums of 64-bit pieces, no decimals, give the sum of the signed hashes."""
    hashes = [-(2**63), 2**63 - 1, -1, 0, 12345678901234567, 2**62, 2**62, 2**62, -7]
    rows = spark.createDataFrame([(value,) for value in hashes], "h BIGINT")
    marks = rows.agg(*walk._row_marks(F.col("h")))
    assert walk._mark_of(marks.first().asDict()) == f"{len(hashes)}:{sum(hashes)}"
    assert walk._mark_of(rows.limit(0).agg(*walk._row_marks(F.col("h"))).first().asDict()) == "0:0"
    assert all(kind == "bigint" for _, kind in marks.dtypes)
