"""Every registered query against its SQL in DuckDB, and facts about the walk as a whole."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from wayloom.operators import links
from wayloom.plans import inputs
from wayloom.plans.oracles import all_oracles
from wayloom.plans.queries import all_queries

QUERIES = {name: entry.queries()[name] for name in all_queries()}
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["crawl_pages", "crawl_nearest"])
def test_walk_facts(spark, sf_dir, name):
    """Each page once, depths within the limit; a nearest page is linked from its section one level up."""
    pages = QUERIES[name](spark, sf_dir)
    assert pages.count() == pages.select("path").distinct().count()
    assert pages.filter("depth_level < 0 OR depth_level > 5").isEmpty()
    if name == "crawl_nearest":
        edges = links.resolved_links(inputs.items(spark, sf_dir))
        parents = pages.selectExpr("path AS src", "section", "depth_level + 1 AS depth_level")
        linked = edges.join(parents, "src").selectExpr("dst AS path", "section", "depth_level").distinct()
        orphans = pages.filter("depth_level > 0").join(linked, ["path", "section", "depth_level"], "left_anti")
        assert orphans.isEmpty()


def test_known_sizes(spark, sf_dir):
    items = inputs.items(spark, sf_dir).filter("requested_path <> '/browse'")
    assert links.item_addresses(items).count() == 1886
    assert links.link_edges(items).select("src", "dst").distinct().count() == 14088
    assert links.resolved_links(items).count() == 12462
    pages = inputs.pages(spark, sf_dir)
    assert pages.count() == 1886
    assert pages.groupBy().sum("depth_level").first()[0] == 5677
    assert QUERIES["crawl_nearest"](spark, sf_dir).groupBy().sum("depth_level").first()[0] == 5629
