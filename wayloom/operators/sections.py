"""Section catalogue, selection and quick samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.content import child_links, content_type
from wayloom.functions.scoring import section_priority
from wayloom.operators.links import link_position

CATALOGUE_ROOT = "/browse"


class NoSectionsError(ValueError):
    """No section is left to work on."""


def _children(items: DataFrame) -> DataFrame:
    return items.select(
        "requested_path", "list_from", F.posexplode(child_links(F.col("links"))).alias("index", "child")
    ).select(
        "requested_path",
        link_position(F.col("list_from"), F.col("index")).alias("pos"),
        F.col("child.title").alias("title"),
        F.col("child.base_path").alias("path"),
    )


def section_catalogue(items: DataFrame, root: str = CATALOGUE_ROOT) -> DataFrame:
    """ord, title, path of the root item's children."""
    children = _children(items.filter(F.col("requested_path") == root))
    return children.select(F.col("pos").cast("int").alias("ord"), "title", "path")


def require_sections(sections: DataFrame, message: str = "No sections found in browse page") -> DataFrame:
    """The same sections; an error when there are none."""
    if sections.isEmpty():
        raise NoSectionsError(message)
    return sections


def select_sections(sections: DataFrame, names: str | None) -> DataFrame:
    """Sections whose title or path is in the comma list; all without a list."""
    if not names:
        return sections
    wanted = [name.strip() for name in names.split(",")]
    chosen = sections.filter(F.col("title").isin(*wanted) | F.col("path").isin(*wanted))
    return require_sections(chosen, "No valid sections specified")


def prioritise_sections(sections: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """path, priority of each section root."""
    return sections.select("path", section_priority(F.col("title"), preferred).alias("priority"))


def section_sample(sections: DataFrame, items: DataFrame) -> DataFrame:
    """title, path, estimated_pages, content_type per section from its root item (A10).

    A section without an item counts no pages and has no type.
    """
    roots = sections.select("ord", "title", F.col("path").alias("requested_path"))
    facts = (
        items.join(roots.select("requested_path").distinct(), "requested_path")
        .groupBy("requested_path")
        .agg(
            F.sum(F.size(child_links(F.col("links")))).cast("bigint").alias("estimated_pages"),
            F.max(F.when(F.col("list_from").isNull(), content_type(F.col("document_type")))).alias("content_type"),
        )
    )
    return roots.join(facts, "requested_path", "left").select(
        "title",
        F.col("requested_path").alias("path"),
        F.coalesce("estimated_pages", F.lit(0).cast("bigint")).alias("estimated_pages"),
        "content_type",
    )


def section_children(sections: DataFrame, items: DataFrame) -> DataFrame:
    """Subsection titles and sample links of each section, one row each, in ``pos`` order (A10)."""
    roots = sections.select(F.col("title").alias("section_title"), F.col("path").alias("requested_path"))
    return _children(items).join(roots, "requested_path").select(
        F.col("requested_path").alias("section"), "section_title", "pos", "title", "path"
    )
