"""Small inputs for the tests."""

from __future__ import annotations

from wayloom.schemas import CONTENT_ITEMS, FETCH_LOG, PAGE_EVENTS, PAGES, SECTIONS

COLUMNS = ("requested_path", "base_path", "title", "body", "document_type", "schema_name", "updated_at", "links",
           "error", "list_from")


def item(path, to=(), *, kind="related", requested=None, **fields):
    """One content item whose links go to ``to``."""
    row = {"requested_path": requested or path, "base_path": path, "title": "T", "body": "B",
           "document_type": "guide", "updated_at": ""}
    row["links"] = {kind: [(None, target) for target in to]} if to else None
    row.update(fields)
    return tuple(row.get(name) for name in COLUMNS)


def items(spark, rows):
    return spark.createDataFrame(list(rows), CONTENT_ITEMS)


def sections(spark, *paths):
    return spark.createDataFrame([(i, f"Section {i}", path) for i, path in enumerate(paths)], SECTIONS)


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def fetches(spark, rows):
    return spark.createDataFrame(rows, FETCH_LOG)


def events(spark, rows):
    return spark.createDataFrame(rows, PAGE_EVENTS)


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)
