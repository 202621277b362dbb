"""A1 to A9, K1 to K4, F5, F6, P7, P8, P11 to P14, S4 to S7."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import build
from wayloom.functions import scoring, times
from wayloom.operators import pages as page_ops
from wayloom.operators import report, trends
from wayloom.sources import exports

NOW = datetime(2024, 2, 1)
AS_OF = "2024-02-01 00:00:00"


def sample(spark):
    def page(path, kind, age, depth, org):
        return ("/s", path, kind, (NOW - timedelta(days=age)).isoformat(), "active", depth, org, 0)

    return build.pages(spark, [
        page("/visit", "answer", 3, 0, "Museum"),
        page("/tickets", "answer", 10, 4, "Box office"),
        page("/shop", "form", 10, 4, "Box office"),
        page("/archive", "answer", 41, 1, ""),
    ])


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_update_patterns(spark):
    row = trends.update_patterns(sample(spark), AS_OF).first()
    assert (row.oldest_update, row.newest_update) == ("2023-12-22T00:00:00", "2024-01-29T00:00:00")
    assert (row.total_updates, row.average_age_days, row.newest_age_days, row.error) == (4, 16.0, 3, None)


def test_distributions(spark):
    frame = sample(spark)
    assert build.rows(trends.content_type_distribution(frame)) == [("/s", "answer", 3), ("/s", "form", 1)]
    assert build.rows(trends.content_type_totals(frame)) == [("/s", 2)]
    assert build.rows(trends.depth_distribution(frame)) == [("/s", 0, 1), ("/s", 1, 1), ("/s", 4, 2)]
    assert build.rows(trends.depth_metrics(frame)) == [("/s", 4, 9 / 4)]
    assert build.rows(trends.org_distribution(frame)) == [("/s", "Box office", 2), ("/s", "Museum", 1)]
    assert build.rows(trends.org_totals(frame)) == [("/s", 2)]
    assert [r.publishing_org for r in trends.top_publishers(frame).orderBy("rank").collect()] == ["Box office", "Museum"]


def test_missing_fields(spark):
    frame = build.pages(spark, [
        ("/s", "/a", None, "", "active", None, "", 0),
        ("/s", "/b", "unknown", None, "active", 3, None, 0),
        ("/s", "/c", "", "not a date", "active", -1, "Org", 0),
    ])
    assert build.rows(trends.content_type_distribution(frame)) == [("/s", "", 1), ("/s", "unknown", 2)]
    assert build.rows(trends.depth_metrics(frame)) == [("/s", 3, 2 / 3)]
    assert build.rows(trends.org_totals(frame)) == [("/s", 1)]
    row = trends.update_patterns(frame, AS_OF).first()
    assert row.total_updates == 0 and row.error == "No update data available" and row.average_age_days is None


def test_ties_and_top_sizes(spark):
    kinds = ["d", "c", "b", "a", "a2", "a2"]
    frame = build.pages(spark, [("/s", f"/p{i}", kind, "", "active", 0, f"org{kind}", 0) for i, kind in enumerate(kinds)])
    top = trends.top_content_types(frame).orderBy("rank").collect()
    assert [(r.content_type, r.n, r.rank) for r in top] == [("a2", 2, 1), ("a", 1, 2), ("b", 1, 3)]
    assert trends.top_publishers(frame).count() == 5
    plan = trends.top_content_types(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_section(spark):
    frame, catalogue = sample(spark), build.sections(spark, "/s", "/empty")
    row = trends.section_trends(frame, catalogue, AS_OF).filter("section = '/empty'").first()
    assert (row.total_updates, row.total_types, row.max_depth, row.average_depth, row.total_organisations) == (0, 0, 0, 0.0, 0)
    assert row.error == "No update data available"
    rep = report.section_report(frame, catalogue, AS_OF).filter("section = '/empty'").first()
    assert (rep.staleness_score, rep.complexity_score, rep.primary_owner) == (1.0, 0.0, None)


def test_section_report(spark):
    catalogue = spark.createDataFrame([(0, None, "/s")], "ord INT, title STRING, path STRING")
    row = report.section_report(sample(spark), catalogue, AS_OF).first()
    assert row.section_title == "Unknown Section" and row.analysis_timestamp == "2024-02-01T00:00:00"
    assert (row.primary_owner, row.primary_owner_pages, row.total_types) == ("Box office", 2, 2)
    assert row.staleness_score == 3 / 365 and row.complexity_score == pytest.approx((0.4 + 0.45) / 2)
    document = report.section_report_documents(sample(spark), catalogue, AS_OF).first()
    assert document.content_freshness.update_patterns.total_updates == 4
    assert [tuple(e) for e in document.type_analysis.most_common] == [(1, "answer", 3), (2, "form", 1)]
    assert document.content_ownership.primary_publishers[0].value == "Box office"


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("2024-01-01", "2024-01-01T00:00:00"), ("2024-01-01T10:20", "2024-01-01T10:20:00"),
        ("2024-01-01T10:20:30Z", "2024-01-01T10:20:30"), ("2024-01-01T10:20:30+01:00", "2024-01-01T09:20:30"),
        ("2024-01-01 10:20:30.5", "2024-01-01T10:20:30.500000"), ("2024", None), ("2024-01", None), ("", None),
        ("2024-13-01", None), ("yesterday", None), (None, None),
    ],
)
def test_parse_iso(spark, text, parsed):
    assert value(spark, times.iso_text(times.parse_iso(F.lit(text).cast("string")))) == parsed


@pytest.mark.parametrize(
    "moment, days",
    [("2024-01-31 00:00:01", 0), ("2024-01-31 00:00:00", 1), ("2024-02-01 00:00:01", -1), ("1600-01-01 00:00:00", 154_894)],
)
def test_age_days(spark, moment, days):
    assert value(spark, times.age_days(F.lit(AS_OF).cast("timestamp"), F.lit(moment).cast("timestamp"))) == days
    assert (NOW - datetime.fromisoformat(moment)).days == days


@pytest.mark.parametrize(
    "delta", [timedelta(0), timedelta(seconds=59, microseconds=999_999), timedelta(hours=1, minutes=2, seconds=3),
              timedelta(days=1, seconds=5), timedelta(days=12, hours=13)],
)
def test_duration_text(spark, delta):
    micros = delta // timedelta(microseconds=1)
    assert value(spark, times.duration_text(F.lit(micros).cast("bigint"))) == str(delta).split(".")[0]


def test_scores(spark):
    score = lambda days: value(spark, scoring.staleness_score(F.lit(days).cast("bigint")))
    assert (score(None), score(0), score(73), score(4000)) == (1.0, 0.0, 0.2, 1.0) and score(-73) == -0.2
    assert value(spark, scoring.complexity_score(F.lit(5), F.lit(2.5))) == 0.5
    assert value(spark, scoring.complexity_score(F.lit(50), F.lit(9.0))) == 1.0


@pytest.mark.parametrize(
    "path, kind, depth, priority",
    [
        ("/x", None, 0, 1), ("/x", "other", 3, 30), ("/x", "guide", 60, 100), ("/x", "detailed_guide", 60, 200),
        ("/x", "service", 60, 300), ("/x", "transaction", 60, 300), ("/services/x", None, 60, 500),
        ("/guidance/x", None, 60, 550), ("/services/guidance/x", None, 60, 450), ("/x", "guide", 1, 1),
    ],
)
def test_url_priority(spark, path, kind, depth, priority):
    column = scoring.url_priority(F.lit(path), F.lit(kind).cast("string"), F.lit(depth))
    assert value(spark, column) == priority


def test_exclude_types_keeps_missing(spark):
    frame = build.pages(spark, [("/s", f"/{k}", k, "", "active", 0, "", 0) for k in ("guide", "topic", None)])
    assert {r.content_type for r in page_ops.exclude_types(frame, ["guide", " topic"]).collect()} == {"topic", None}
    assert page_ops.exclude_types(frame, []).count() == 3


def test_build_pages(spark):
    frame = build.items(spark, [
        build.item("/r", ["/a", "/old"]), build.item("/r", ["/a"], list_from=2),
        build.item("/a", ["/x"], body=None, links={"organisations": [("Org", None)], "related": [(None, "/x")]}),
        build.item("/b", ["/x"], requested="/old"), build.item("/b", ["/x"], requested="/older"),
        build.item("/unreached"),
    ])
    crawled = spark.createDataFrame(
        [("/r", "/r", 0), ("/r", "/a", 1), ("/r", "/b", 2)], "section STRING, path STRING, depth_level INT")
    built = page_ops.build_pages(crawled, frame, max_depth=2)
    assert built.columns == ["section", "path", "content_type", "last_updated", "status", "depth_level",
                             "publishing_org", "related_links_count"]
    assert build.rows(built.select("path", "status", "publishing_org", "related_links_count")) == [
        ("/a", "placeholder", "Org", 1), ("/b", "active", "", 0), ("/r", "active", "", 3)]
    rollup = page_ops.section_rollup(built).first()
    assert (rollup.total_pages, rollup.active_pages, rollup.placeholder_pages) == (3, 2, 1)
    assert tuple(page_ops.scan_metadata(built, 2, AS_OF).first()) == ("2024-02-01T00:00:00", 2, 3, 1)


def read_lines(path, pattern):
    return [line for part in sorted(path.glob(pattern)) for line in part.read_text(encoding="utf-8").splitlines()]


def test_csv_export(spark, tmp_path):
    frame = build.pages(spark, [("/s", "/tides", "answer", "2023-11-05", "active", 3, "Harbour, north", 4)]).coalesce(1)
    assert exports.write_csv(frame, str(tmp_path / "out"))
    lines = read_lines(tmp_path / "out", "*.csv")
    assert lines == ["section,path,content_type,status,depth_level,publishing_org,last_updated,related_links_count",
                     '/s,/tides,answer,active,3,"Harbour, north",2023-11-05,4']
    with pytest.warns(UserWarning, match="No data"):
        assert not exports.write_csv(frame.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_json_export(spark, tmp_path):
    frame = build.pages(spark, [("/s", "/tides", "answer", None, "active", 3, "Büro", 2)])
    catalogue = build.sections(spark, "/s")
    tables = {"metadata": page_ops.scan_metadata(frame, 5, AS_OF), "sections": page_ops.section_rollup(frame), "pages": frame,
              "page_links": page_ops.page_links(frame, build.items(spark, [build.item("/tides", ["/moon"])]), 5),
              "section_depths": trends.depth_distribution(frame), "progress": frame.limit(0),
              "type_distribution": trends.content_type_distribution(frame),
              "depth_distribution": trends.depth_distribution(frame), "org_distribution": trends.org_distribution(frame),
              "trends": trends.section_trends(frame, catalogue, AS_OF),
              "reports": report.section_report_documents(frame, catalogue, AS_OF)}
    exports.export(tables, str(tmp_path / "json"), "json")
    [line] = read_lines(tmp_path / "json" / "pages", "*.json")
    assert "Büro" in line and json.loads(line)["last_updated"] is None
    [link] = read_lines(tmp_path / "json" / "page_links", "*.json")
    assert json.loads(link) == {"section": "/s", "path": "/tides", "link_type": "related", "pos": 0, "dst": "/moon"}
    [sections] = read_lines(tmp_path / "json" / "sections", "*.json")
    assert json.loads(sections)["total_pages"] == 1
    exports.export(tables, str(tmp_path / "analysis"), "analysis")
    [line] = read_lines(tmp_path / "analysis" / "reports", "*.json")
    assert json.loads(line)["content_freshness"]["staleness_score"] == 1.0
    with pytest.raises(ValueError):
        exports.export(tables, str(tmp_path / "x"), "xml")


def test_report_export(spark, tmp_path):
    totals = spark.createDataFrame([(3, 7, 2, "0:12:00")],
                                   "sections_analyzed LONG, total_links_found LONG, rate_limit_hits LONG, scan_duration STRING")
    types = spark.createDataFrame([("form", 4), ("answer", 3)], "content_type STRING, n LONG")
    lines = report.report_lines(totals, types, AS_OF, title="My Report")
    exports.export({"lines": lines}, str(tmp_path / "out"), "report")
    assert read_lines(tmp_path / "out", "*.txt") == [
        "My Report", "=" * 30, "Generated: 2024-02-01T00:00:00", "Duration: 0:12:00", "", "Summary", "-" * 7,
        "Sections analyzed: 3", "Total links found: 7", "Rate limit hits: 2", "", "Content Types", "-" * 12,
        "answer: 3", "form: 4"]


def test_output_path():
    assert exports.output_path("data/", "20240201_000000", "csv") == "data/content_20240201_000000.csv"
    with pytest.raises(ValueError):
        exports.output_path("data", "x", "xml")
