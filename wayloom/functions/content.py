"""Column expressions over one content item and over one link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.schemas import LINK, LINKS

# Path parts of files that are not content.
EXCLUDED_PARTS = ("/assets/", "/images/", "/attachments/")

# JSON texts of a body that holds nothing.
EMPTY_BODIES = ("", "{}", "[]", "false", "0")


def _list(links: Column) -> Column:
    return F.coalesce(links, F.array().cast(f"ARRAY<{LINK}>"))


def content_type(document_type: Column) -> Column:
    return F.coalesce(document_type, F.lit("unknown"))


def last_updated(updated_at: Column) -> Column:
    return F.coalesce(updated_at, F.lit(""))


def page_status(error: Column, title: Column, body: Column, schema_name: Column) -> Column:
    """``placeholder`` for missing, empty or placeholder documents, else ``active``."""
    placeholder = (
        F.coalesce(error == "not_found", F.lit(False))
        | (F.coalesce(title, F.lit("")) == "")
        | F.coalesce(body, F.lit("")).isin(*EMPTY_BODIES)
        | F.coalesce(schema_name == "placeholder", F.lit(False))
    )
    return F.when(placeholder, F.lit("placeholder")).otherwise(F.lit("active"))


def publishing_org(links: Column) -> Column:
    """Title of the first organisation link, or the empty text."""
    first = F.get(_list(F.try_element_at(links, F.lit("organisations"))), F.lit(0))
    return F.coalesce(first["title"], F.lit(""))


def link_lists(links: Column) -> Column:
    """Array of (link_type, array of links), never null at either level."""
    return F.map_entries(F.coalesce(links, F.create_map().cast(LINKS)))


def related_links(links: Column) -> Column:
    """Targets of all links in type order, then position, copies kept."""
    every = F.flatten(F.transform(link_lists(links), lambda entry: _list(entry["value"])))
    return F.transform(
        F.filter(every, lambda link: link["base_path"].isNotNull()), lambda link: link["base_path"]
    )


def related_links_count(links: Column) -> Column:
    """How many targets ``related_links`` has, by built-in functions alone unless a list is null."""
    targets = F.flatten(F.map_values(links))["base_path"]
    return F.coalesce(F.array_size(F.array_compact(targets)), F.array_size(related_links(links)))


def related_links_within(links: Column, depth: Column, max_depth: int) -> Column:
    """The same, but empty where the walk stops (P5)."""
    return F.when(depth < max_depth, related_links(links)).otherwise(F.array().cast("ARRAY<STRING>"))


def child_links(links: Column) -> Column:
    """``children`` entries that have both a title and a path."""
    children = _list(F.try_element_at(links, F.lit("children")))
    return F.filter(children, lambda c: c["title"].isNotNull() & c["base_path"].isNotNull())


def is_followable(path: Column) -> Column:
    """Site-internal and not a file (F1)."""
    keep = path.startswith("/")
    for part in EXCLUDED_PARTS:
        keep = keep & ~path.contains(part)
    return F.coalesce(keep, F.lit(False))


def content_url(path: Column, base: str) -> Column:
    """Request URL of a path: one slash between base and path (S3)."""
    return F.concat(F.lit(base if base.endswith("/") else base + "/"), F.ltrim(path, F.lit("/")))


def section_of_path(path: Column) -> Column:
    """``/`` and the first segment."""
    return F.concat(F.lit("/"), F.split_part(F.btrim(path, F.lit("/")), F.lit("/"), F.lit(1)))
