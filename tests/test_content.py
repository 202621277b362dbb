"""P1 to P6, P9, S1 to S3, F1, F2, P16."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import build
from wayloom.functions import content
from wayloom.operators import links, pages
from wayloom.schemas import CONTENT_ITEMS
from wayloom.sources import items as source
from wayloom.sources import testdata


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "title, body, schema, error, status",
    [
        (None, None, None, None, "placeholder"),
        ("Opening hours", "Daily from nine", "answer", None, "active"),
        ("Opening hours", None, "placeholder", None, "placeholder"),
        ("Opening hours", "Daily from nine", "placeholder", None, "placeholder"),
        ("", "Daily from nine", None, None, "placeholder"),
        ("Opening hours", "", None, None, "placeholder"),
        ("Opening hours", "{}", None, None, "placeholder"),
        ("Opening hours", "[]", None, None, "placeholder"),
        ("Opening hours", "Daily from nine", None, None, "active"),
        ("Opening hours", "Daily from nine", None, "not_found", "placeholder"),
    ],
)
def test_page_status(spark, title, body, schema, error, status):
    text = lambda x: F.lit(x).cast("string")
    assert value(spark, content.page_status(text(error), text(title), text(body), text(schema))) == status


def test_related_links_keep_type_order_and_copies(spark):
    frame = build.items(spark, [
        build.item("/a", links={"related": [(None, "/gallery"), (None, "/cafe"), ("no path", None), (None, "/gallery")],
                                "organisations": [("Trust", "/trust")]}),
        build.item("/b"),
        build.item("/c", links={"related": None, "organisations": []}),
    ])
    found = {r[0]: r[1] for r in frame.select("base_path", content.related_links(F.col("links"))).collect()}
    assert sorted(found["/a"]) == ["/cafe", "/gallery", "/gallery", "/trust"]
    assert [x for x in found["/a"] if x != "/trust"] == ["/gallery", "/cafe", "/gallery"]
    assert found["/b"] == [] and found["/c"] == []
    assert build.rows(links.link_counts(frame)) == [("/a", 4), ("/b", 0), ("/c", 0)]


def test_related_links_stop_at_depth_limit(spark):
    frame = build.items(spark, [build.item("/a", ["/x"])])
    at = lambda depth: frame.select(content.related_links_within(F.col("links"), F.lit(depth), 2)).first()[0]
    assert at(1) == ["/x"] and at(2) == []


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_link_rows(spark, ansi):
    frame = build.items(spark, [
        build.item("/a", links={"related": [(None, "/x"), ("no path", None)], "children": None, "other": [(None, "/y")]}),
        build.item("/b"),
    ])
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert [r[0] for r in frame.select(links.link_rows(F.col("links"))).collect()] == [3, 0]
        assert build.rows(links.link_counts(frame)) == [("/a", 2), ("/b", 0)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_link_positions_run_over_parts(spark):
    frame = build.items(spark, [
        build.item("/a", ["/x", "/y"]),
        build.item("/a", ["/z", "/w"], list_from=2),
    ])
    assert build.rows(links.link_edges(frame)) == [
        ("/a", "related", 0, "/x"), ("/a", "related", 1, "/y"), ("/a", "related", 2, "/z"), ("/a", "related", 3, "/w"),
    ]


def test_publishing_org(spark):
    frame = build.items(spark, [
        build.item("/a", links={"organisations": [("First", None), ("Second", None)]}),
        build.item("/b", links={"organisations": []}),
        build.item("/c", links={"organisations": [(None, "/o")]}),
        build.item("/d", links={"related": [(None, "/x")]}),
        build.item("/e"),
    ])
    found = build.rows(frame.select("base_path", content.publishing_org(F.col("links"))))
    assert found == [("/a", "First"), ("/b", ""), ("/c", ""), ("/d", ""), ("/e", "")]


def test_child_links_need_title_and_path(spark):
    frame = build.items(spark, [
        build.item("/a", links={"children": [("T1", "/1"), (None, "/2"), ("T3", None), ("T4", "/4")]}),
    ])
    assert [tuple(c) for c in frame.select(content.child_links(F.col("links"))).first()[0]] == [("T1", "/1"), ("T4", "/4")]


@pytest.mark.parametrize(
    "path, keep",
    [
        ("/harbour/tides", True), ("/assets/map.svg", False), ("/images/pier.webp", False),
        ("https://harbour.example", False), ("/docs/attachments/x.pdf", False), ("/assets", True), ("", False), (None, False),
    ],
)
def test_followable(spark, path, keep):
    assert value(spark, content.is_followable(F.lit(path).cast("string"))) is keep


@pytest.mark.parametrize(
    "path, section",
    [("/harbour/tides/today", "/harbour"), ("/", "/"), ("//a/b", "/a"), ("", "/"), ("a/b/", "/a")],
)
def test_section_of_path(spark, path, section):
    assert value(spark, content.section_of_path(F.lit(path))) == section


def test_content_url(spark):
    for base in ("https://content.example.org/api", "https://content.example.org/api/"):
        for path in ("/x/y", "x/y", "//x/y"):
            assert value(spark, content.content_url(F.lit(path), base)) == "https://content.example.org/api/x/y"


def test_page_record_defaults(spark):
    frame = build.items(spark, [
        build.item("/a", document_type=None, updated_at=None),
        build.item("/b", document_type="", updated_at="2024-01-01"),
        build.item(None, error="not_found", requested="/gone"),
        build.item("", requested="/empty"),
        build.item("/a", ["/more"], list_from=0, document_type=None),
    ])
    found = build.rows(pages.page_records(frame).select("path", "content_type", "last_updated"))
    assert found == [("/a", "unknown", ""), ("/b", "", "2024-01-01")]


def test_fetch_outcomes(spark):
    good = json.dumps({"base_path": "/a", "title": "T", "body": "B", "links": {"related": [{"base_path": "/b"}]}})
    odd = json.dumps({"base_path": "/odd", "title": "T", "body": {}, "links": {
        "related": "not a list", "more": ["plain", {"base_path": "/kept"}, 7, {"title": "no path"}], "none": []}})
    log = build.fetches(spark, [
        (1, "c", "/a", None, 200, good, None),
        (2, "c", "/b", None, 404, None, None),
        (3, "c", "/c", None, 429, None, None),
        (4, "c", "/d", None, 503, None, None),
        (5, "c", "/e", None, 200, "{bad", None),
        (6, "c", "/f", None, None, None, "timeout"),
        (7, "c", "/g", None, None, None, "connection"),
        (8, "c", "/h", None, 200, None, None),
        (9, "c", "/odd", None, 200, odd, None),
    ])
    outcomes = {r.request_id: r.outcome for r in source.classify_fetches(log).collect()}
    bad_json = "Invalid JSON response from API"
    assert outcomes == {1: "ok", 2: "not_found", 3: "Rate limit exceeded", 4: "HTTP 503", 5: bad_json,
                        6: "Request timed out", 7: "Request failed", 8: bad_json, 9: "ok"}
    landed = {r.requested_path: r for r in source.items_from_fetches(log).collect()}
    assert set(landed) == {"/a", "/b", "/odd"}
    assert landed["/b"].error == "not_found" and landed["/b"].base_path is None
    assert landed["/a"].links["related"][0].base_path == "/b"
    assert landed["/odd"].base_path == "/odd" and set(landed["/odd"].links) == {"more", "none"}
    assert [(link.title, link.base_path) for link in landed["/odd"].links["more"]] == [(None, "/kept"), ("no path", None)]
    status = {r.path: r.status for r in pages.page_records(source.items_from_fetches(log)).collect()}
    assert status == {"/a": "active", "/odd": "placeholder"}


def test_repeated_keys_and_refetches(spark):
    at = [datetime(2024, 1, day) for day in range(1, 5)]
    page = lambda title: f'{{"base_path": "/a", "title": "old", "title": "{title}"}}'
    log = build.fetches(spark, [
        (1, "c", "/a", at[0], 200, page("first"), None), (2, "c", "/a", at[2], 200, page("last"), None),
        (3, "c", "/a", at[1], 404, None, None), (4, "c", "/a", at[3], 500, None, None),
        (5, "c", "/b", at[0], 200, page("b"), None), (6, "c", "/b", at[1], 404, None, None),
        (7, "c", "/s", at[0], 200, "[1]", None), (8, "c", "/n", at[0], 200, '{"links": null, "title": 5}', None),
    ])
    landed = {r.requested_path: r for r in source.items_from_fetches(log).collect()}
    assert len(landed) == 4 and landed["/a"].title == "last" and landed["/a"].error is None
    assert landed["/b"].error == "not_found" and landed["/b"].title is None
    assert landed["/s"].base_path is None and (landed["/n"].title, landed["/n"].links) == ("5", None)


def test_large_bodies_are_read(spark, monkeypatch):
    """What a variant can't hold is read as a map; NaN stands in for a size over the reader's limit."""
    monkeypatch.setattr(source, "MAX_BODY_BYTES", 150)
    body = '{"base_path": "/a", "title": 7, "x": NaN, "links": {"related": ["x", {"base_path": "/b"}], "odd": 1}, "body": "' + "y" * 200
    log = build.fetches(spark, [
        (i, "c", f"/a{i}", None, 200, text, None) for i, text in enumerate([body + '"}', body, '{"title": NaN', '{"title": NaN}'])
    ])
    outcomes = {r.request_id: r.outcome for r in source.classify_fetches(log).collect()}
    bad_json = "Invalid JSON response from API"
    assert outcomes == {0: "ok", 1: "Response too large to parse", 2: bad_json, 3: bad_json}
    [row] = source.items_from_fetches(log).collect()
    assert (row.requested_path, row.base_path, row.title, row.body) == ("/a0", "/a", "7", "y" * 200)
    assert {kind: [link.base_path for link in links] for kind, links in row.links.items()} == {"related": ["/b"]}


def test_bodies_are_parsed_once_and_never_sorted(spark, sf_dir):
    log = testdata.site_fetches(spark, sf_dir)
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert plan(source.answers(log)).count("VariantExpressionEvalUtils.parseJson(body") == 1
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    text = plan(source.items_from_fetches(log))
    for line in text.splitlines():
        if "Sort" in line or "Aggregate" in line:
            assert "body" not in line and "title" not in line
    assert "ShuffledHashJoin" in text and text.count("Exchange hashpartitioning(row") == 2


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_read_items_round_trip(spark, tmp_path, fmt):
    frame = build.items(spark, [build.item("/a", ["/b"], requested="/old"), build.item("/b")])
    path = str(tmp_path / fmt)
    frame.write.format(fmt).save(path)
    back = source.read_items(spark, path, fmt)
    assert build.rows(back) == build.rows(frame)
    assert back.schema.simpleString() == frame.schema.simpleString()


def test_read_raw_documents(spark, tmp_path):
    """Plain documents need not carry requested_path or list_from."""
    path = tmp_path / "raw.json"
    path.write_text(json.dumps({"base_path": "/a", "title": "Ü", "document_type": "guide"}) + "\n", encoding="utf-8")
    row = source.read_items(spark, str(path), "json").first()
    assert (row.requested_path, row.list_from, row.title, row.links) == ("/a", None, "Ü", None)
    assert CONTENT_ITEMS.startswith("requested_path")


def test_links_are_counted_by_built_in_functions(spark):
    """A list that is null is left to the plain way; both give the number of targets."""
    frame = build.items(spark, [
        build.item("/a", links={"related": [(None, "/x"), None, ("no path", None)], "other": [(None, "/x")]}),
        build.item("/b", links={"related": None, "other": [(None, "/y")]}),
        build.item("/c", links={}),
        build.item("/d"),
    ])
    count, every = content.related_links_count(F.col("links")), F.size(content.related_links(F.col("links")))
    assert [tuple(r) for r in frame.select(count, every).collect()] == [(2, 2), (1, 1), (0, 0), (0, 0)]
    assert "array_size(flatten(map_values(links" in str(links.link_rows(F.col("links")))
