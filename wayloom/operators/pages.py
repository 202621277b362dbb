"""Page records, the page table and its rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.content import content_type, last_updated, page_status, publishing_org, related_links_count
from wayloom.functions.times import instant, iso_text
from wayloom.operators.links import link_edges


def _has_path() -> Column:
    return F.coalesce("base_path", F.lit("")) != ""


def page_records(items: DataFrame) -> DataFrame:
    """One row per item that has a path, with the defaults for missing fields."""
    return items.filter(F.col("list_from").isNull() & _has_path()).select(
        "requested_path",
        F.col("base_path").alias("path"),
        content_type(F.col("document_type")).alias("content_type"),
        last_updated(F.col("updated_at")).alias("last_updated"),
        page_status(F.col("error"), F.col("title"), F.col("body"), F.col("schema_name")).alias("status"),
        publishing_org(F.col("links")).alias("publishing_org"),
    )


def build_pages(crawled: DataFrame, items: DataFrame, max_depth: int) -> DataFrame:
    """The page table: where each page was found, joined with what its item says.

    An item that several links redirect to is read once, by its first address.
    Link counts are 0 at the depth limit, where links are not looked at (P5, P10).
    """
    counts = (
        items.filter(_has_path())
        .groupBy(F.col("base_path").alias("path"), "requested_path")
        .agg(F.sum(related_links_count(F.col("links"))).alias("n_links"))
    )
    # The facts are worked out below the join, so no sort or shuffle ever carries a body.
    documents = page_records(items).join(counts, ["path", "requested_path"], "left")
    facts = F.struct("requested_path", "content_type", "last_updated", "status", "publishing_org", "n_links")
    records = documents.groupBy("path").agg(F.min(facts).alias("record"))
    n_links = F.when(F.col("depth_level") < max_depth, F.col("n_links")).otherwise(F.lit(0))
    return (
        crawled.join(records, "path")
        .select("section", "path", "depth_level", "record.*")
        .select(
            "section", "path", "content_type", "last_updated", "status", "depth_level", "publishing_org",
            n_links.cast("bigint").alias("related_links_count"),
        )
    )


def exclude_types(pages: DataFrame, types: Sequence[str]) -> DataFrame:
    """Pages of other types; pages without a type stay (F5). Runs after the walk."""
    if not types:
        return pages
    return pages.filter(~F.coalesce(F.col("content_type").isin(*types), F.lit(False)))


def section_rollup(pages: DataFrame) -> DataFrame:
    """Page counts per section: all, active, placeholder (A5). Of pages or of their cells."""
    one = F.col("n_pages") if "n_pages" in pages.columns else F.lit(1)
    counted = lambda wanted: F.sum(F.when(wanted, one).otherwise(0)).cast("bigint")
    active = F.col("status") == "active"
    return pages.groupBy("section").agg(
        F.sum(one).cast("bigint").alias("total_pages"),
        counted(active).alias("active_pages"),
        counted(F.col("status") != "active").alias("placeholder_pages"),
    )


def page_links(pages: DataFrame, items: DataFrame, max_depth: int) -> DataFrame:
    """section, path, link_type, pos, dst: the links of all pages below the depth limit (P5).

    An item with several addresses is read once, by its first one, as in the page table. Items
    meet their pages with their lists whole; the links are taken out of them after that.
    """
    first = (
        items.filter(F.col("list_from").isNull() & _has_path())
        .groupBy(F.col("base_path").alias("path")).agg(F.min("requested_path").alias("requested_path"))
    )
    below = pages.filter(F.col("depth_level") < max_depth).select("section", "path").join(first, "path")
    lists = items.filter(related_links_count(F.col("links")) > 0).select(
        F.col("base_path").alias("path"), "requested_path", "list_from", "links"
    )
    linking = below.join(lists, ["path", "requested_path"]).withColumnRenamed("path", "base_path")
    return link_edges(linking, "section").select("section", F.col("src").alias("path"), "link_type", "pos", "dst")


def scan_metadata(pages: DataFrame, max_depth: int, as_of: str | Column) -> DataFrame:
    """One row: when the scan was made, its pages, sections and depth limit (A6). Of pages or of their cells."""
    total = F.sum("n_pages") if "n_pages" in pages.columns else F.count(F.lit(1))
    return pages.agg(
        iso_text(instant(as_of)).alias("scanned_at"),
        F.lit(max_depth).alias("depth_limit"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total_pages"),
        F.count_distinct("section").alias("sections_covered"),
    )


def export_columns(pages: DataFrame) -> DataFrame:
    """The flat export shape."""
    return pages.select(
        "section", "path", "content_type", "status", "depth_level", "publishing_org", "last_updated",
        "related_links_count",
    )
