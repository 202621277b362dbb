"""Every section that reaches a page, against a search from each section alone."""

import random
from collections import defaultdict

import pytest

from tests import build
from wayloom.operators import crawl, reach
from wayloom.session import fresh_dir
from wayloom.sources.state import CrawlState


def reached(edges, roots, nodes, max_depth):
    follow = defaultdict(set)
    for src, dst in edges:
        follow[src].add(dst)
    found = []
    for root in roots:
        level, seen = {root} & set(nodes), set()
        for depth in range(max_depth + 1):
            found += [(root, path, depth) for path in level]
            seen |= level
            level = {dst for path in level for dst in follow[path]} & set(nodes) - seen
    return sorted(found, key=repr)


def graph(spark, edges, nodes):
    follow = defaultdict(list)
    for src, dst in edges:
        follow[src].append(dst)
    return build.items(spark, [build.item(node, follow[node]) for node in nodes])


@pytest.mark.parametrize("max_depth", [0, 4])
def test_more_sections_than_a_word(spark, max_depth):
    rng = random.Random(4)
    nodes = [f"/n{i}" for i in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(260)] + [("/n9", node) for node in nodes[::3]]
    edges += [("/n1", "/missing"), ("/n2", "/n2")]
    roots = [*nodes[:130], "/absent"]
    found = reach.section_reach(graph(spark, edges, nodes), build.sections(spark, *roots), max_depth=max_depth, bucket_rows=60)
    assert build.rows(found) == reached(edges, roots, nodes, max_depth)


def test_no_sections_and_sparse_numbers(spark):
    frame = graph(spark, [("/a", "/b")], ["/a", "/b"])
    assert reach.section_reach(frame, build.sections(spark)).count() == 0
    roots = spark.createDataFrame([(700, "A", "/a"), (63, "B", "/b")], "ord INT, title STRING, path STRING")
    assert build.rows(reach.section_reach(frame, roots)) == [("/a", "/a", 0), ("/a", "/b", 1), ("/b", "/b", 0)]


def test_a_level_has_one_row_per_page(spark):
    """Sixty sections link to one page: one row, and links, addresses and the seen are not shuffled."""
    roots = [f"/r{i}" for i in range(60)]
    frame = graph(spark, [(root, "/x") for root in roots], [*roots, "/x"])
    store = CrawlState(spark, fresh_dir(spark, "reach"))
    try:
        layout = crawl.stage_graph(frame, store)
        level = reach._save(store, 0, reach._roots(build.sections(spark, *roots).selectExpr("ord", "path AS section"), layout), layout)
        following = reach.next_bits(level, level, layout)
        assert [(r.path, bin(r.bits & (1 << 64) - 1).count("1")) for r in following.collect()] == [("/x", 60)]
        plan = following._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(" in line]
        assert 1 <= len(moved) <= 2 and all("dst" in line or "requested_path" in line or "page" in line for line in moved)
    finally:
        store.release()
