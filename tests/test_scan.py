"""A whole scan of a small site."""

import json

import pytest

from tests import build
from wayloom.operators.sections import NoSectionsError
from wayloom.plans.scan import choose_sections, sample, scan
from wayloom.sources import exports

AS_OF = "2024-02-01 00:00:00"


def site(spark):
    return build.items(spark, [
        build.item("/browse", links={"children": [("One", "/one"), ("Two", "/two"), ("Lost", "/lost")]}),
        build.item("/one", ["/a", "/topic"], document_type="browse_page"),
        build.item("/two", ["/a", "/b"], document_type="browse_page"),
        build.item("/topic", ["/behind"], document_type="topic"),
        build.item("/a", updated_at="2024-01-01T00:00:00Z", links={"organisations": [("Org", None)]}),
        build.item("/b", body=None),
        build.item("/behind"),
    ])


def test_scan(spark, tmp_path):
    tables = scan(site(spark), as_of=AS_OF, excluded=["topic"], detail="detailed")
    assert build.rows(tables["pages"].select("section", "path", "depth_level")) == [
        ("/one", "/a", 1), ("/one", "/behind", 2), ("/one", "/one", 0), ("/two", "/b", 1), ("/two", "/two", 0)]
    # Excluded pages leave the pages and analyses; what counts the scan still counts them.
    assert tuple(tables["metadata"].first()) == ("2024-02-01T00:00:00", 5, 6, 2)
    assert build.rows(tables["sections"]) == [("/one", 4, 4, 0), ("/two", 2, 1, 1)]
    assert build.rows(tables["section_depths"]) == [("/one", 0, 1), ("/one", 1, 2), ("/one", 2, 1), ("/two", 0, 1), ("/two", 1, 1)]
    assert ("content_type", "topic", 1) in build.rows(tables["progress"]) and ("depth", "2", 1) in build.rows(tables["progress"])
    assert build.rows(tables["page_links"].select("path", "dst")) == [("/one", "/a"), ("/one", "/topic"), ("/two", "/a"), ("/two", "/b")]
    assert {r.content_type for r in tables["type_distribution"].collect()} == {"browse_page", "guide"}
    assert {r.section: r.total_updates for r in tables["trends"].collect()} == {"/one": 1, "/two": 0, "/lost": 0}
    assert {r.section_title for r in tables["reports"].collect()} == {"One", "Two", "Lost"}
    lines = {r.line for r in tables["lines"].collect()}
    assert {"Sections analyzed: 2", "Total links found: 6", "Duration: N/A", "browse_page: 2", "guide: 3"} <= lines
    for fmt in exports.FORMATS:
        exports.export(tables, str(tmp_path / fmt), fmt)
    written = [json.loads(line) for part in (tmp_path / "json" / "pages").glob("*.json")
               for line in part.read_text().splitlines()]
    assert len(written) == 5


def test_published_as_one(spark, tmp_path):
    """Every table of a run reads back; a run without its manifest row is not seen."""
    path = str(tmp_path / "out")
    assert exports.published(spark, path) == {}
    tables = scan(site(spark), as_of=AS_OF, detail="detailed")
    for fmt, names in (("json", exports.JSON_TABLES), ("analysis", exports.ANALYSIS_TABLES)):
        exports.publish(tables, path, fmt)
        back = exports.published(spark, path)
        assert set(back) == set(names)
        for name in names:
            assert back[name].schema.simpleString() == tables[name].schema.simpleString()
            assert build.rows(back[name]) == build.rows(tables[name])
    fewer = scan(site(spark), as_of=AS_OF, names="Two")
    exports.export(fewer, f"{path}/run-3-torn", "json")
    assert exports.published(spark, path)["trends"].count() == 3
    exports.publish(fewer, path, "json")
    assert {r.path for r in exports.published(spark, path)["pages"].collect()} == {"/two", "/a", "/b"}
    for fmt, name, rows in (("csv", "pages", 3), ("report", "lines", 17)):
        exports.publish(fewer, path, fmt)
        assert exports.published(spark, path)[name].count() >= min(rows, 3)


def test_cells_stand_for_pages(spark):
    from wayloom.operators import pages, report, trends

    tables = scan(site(spark), as_of=AS_OF)
    found, cells, chosen = tables["pages"], tables["cells"], tables["catalogue"]
    for operator in (trends.content_type_distribution, trends.content_type_totals, trends.depth_distribution, trends.depth_metrics,
                     trends.org_distribution, trends.org_totals, trends.top_content_types, trends.top_publishers, pages.section_rollup):
        assert build.rows(operator(cells)) == build.rows(operator(found))
    assert build.rows(trends.section_trends(cells, chosen, AS_OF)) == build.rows(trends.section_trends(found, chosen, AS_OF))
    assert build.rows(report.section_report(cells, chosen, AS_OF)) == build.rows(report.section_report(found, chosen, AS_OF))
    assert build.rows(pages.scan_metadata(cells, 5, AS_OF)) == build.rows(pages.scan_metadata(found, 5, AS_OF))
    parts = trends.page_cells(found.filter("depth_level < 1")).unionByName(trends.page_cells(found.filter("depth_level >= 1")))
    assert build.rows(trends.merge_cells(parts)) == build.rows(cells)
    assert build.rows(trends.section_trends(trends.page_cells(found.limit(0)), chosen, AS_OF)) == build.rows(
        trends.section_trends(found.limit(0), chosen, AS_OF))


def test_scan_of_chosen_sections(spark):
    tables = scan(site(spark), as_of=AS_OF, names="Two", max_depth=1)
    assert {r.path for r in tables["pages"].collect()} == {"/two", "/a", "/b"} and "reports" not in tables
    with pytest.raises(NoSectionsError):
        scan(site(spark), as_of=AS_OF, names="Nothing")
    with pytest.raises(ValueError):
        scan(site(spark), as_of=AS_OF, detail="full")


def test_report_figures_from_the_fetch_log(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    log = build.fetches(spark, [
        (i, "c", "/x", start + timedelta(minutes=i), 429 if i % 2 else 200, "{}", None) for i in range(4)])
    lines = {r.line for r in scan(site(spark), as_of=AS_OF, fetch_log=log)["lines"].collect()}
    assert {"Rate limit hits: 2", "Duration: 0:03:00"} <= lines


def test_sample(spark):
    found = sample(site(spark))
    assert build.rows(found["samples"]) == [
        ("Lost", "/lost", 0, None), ("One", "/one", 0, "browse_page"), ("Two", "/two", 0, "browse_page")]
    assert found["children"].isEmpty()


def test_catalogue_is_taken_from_the_items_once(spark):
    chosen = choose_sections(site(spark), "Two")
    assert build.rows(chosen.select("path")) == [("/two",)]
    assert chosen.inputFiles() and all("/sections-" in name for name in chosen.inputFiles())
