"""Row shapes of the tables the operators read and write."""

from __future__ import annotations

LINK = "STRUCT<title: STRING, base_path: STRING>"
LINKS = f"MAP<STRING, ARRAY<{LINK}>>"

# The JSON document of one item, as the content API returns it.
DOCUMENT = (
    "base_path STRING, title STRING, body STRING, document_type STRING, "
    f"schema_name STRING, updated_at STRING, links {LINKS}"
)

# A landed item, one document per ``requested_path``. That is the link that was followed;
# it differs from ``base_path`` on redirects. ``list_from`` is null for the item's own
# document. An item with more links than fit in one row goes on in further rows: they carry
# the two paths and ``links`` only, and ``list_from`` is the place of their first link in
# its list.
CONTENT_ITEMS = f"requested_path STRING, {DOCUMENT}, error STRING, list_from BIGINT"

FETCH_LOG = (
    "request_id BIGINT, client STRING, requested_path STRING, fetched_at TIMESTAMP, "
    "http_status INT, body STRING, transport_error STRING"
)
LINK_EDGES = "src STRING, link_type STRING, pos BIGINT, dst STRING"
SECTIONS = "ord INT, title STRING, path STRING"
PAGES = (
    "section STRING, path STRING, content_type STRING, last_updated STRING, status STRING, "
    "depth_level INT, publishing_org STRING, related_links_count BIGINT"
)
PAGE_EVENTS = (
    "event_id BIGINT, event_time TIMESTAMP, section STRING, section_started BOOLEAN, "
    "links_found BIGINT, depth INT, content_type STRING, rate_limited BOOLEAN"
)
