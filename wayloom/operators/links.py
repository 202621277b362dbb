"""The link graph as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.content import is_followable, related_links_count


def link_edges(items: DataFrame, *more: str) -> DataFrame:
    """One row per link that has a target: src, link_type, pos, dst (P4), and ``more`` columns of its item."""
    lists = items.select(
        F.col("base_path").alias("src"), *more, "list_from", F.explode("links").alias("link_type", "entries")
    )
    placed = lists.select("src", *more, "list_from", "link_type", F.posexplode("entries").alias("index", "link"))
    return placed.filter(F.col("link.base_path").isNotNull()).select(
        "src", *more, "link_type", link_position(F.col("list_from"), F.col("index")).alias("pos"),
        F.col("link.base_path").alias("dst"),
    )


def link_position(list_from: Column, index: Column) -> Column:
    """Place in the item's whole list of a link found at ``index`` of one row."""
    return F.coalesce(list_from, F.lit(0)) + index


def link_counts(items: DataFrame) -> DataFrame:
    """Links with a target per item, copies included: path, n_links."""
    return (
        items.groupBy(F.col("base_path").alias("path"))
        .agg(F.sum(related_links_count(F.col("links"))).cast("bigint").alias("n_links"))
    )


def link_rows(links: Column) -> Column:
    """Entries in all lists of one row, with or without a target. Only a null list needs the sum of the sizes."""
    return F.coalesce(
        F.array_size(F.flatten(F.map_values(links))),
        F.aggregate(F.map_values(links), F.lit(0), lambda total, entries: total + F.coalesce(F.array_size(entries), F.lit(0))),
        F.lit(0),
    )


def followable_edges(items: DataFrame) -> DataFrame:
    """src, dst of the links worth following (F1). Copies stay; the walk merges them."""
    lists = items.filter(F.coalesce("base_path", F.lit("")) != "").select(
        F.col("base_path").alias("src"), F.explode("links").alias("link_type", "entries")
    )
    targets = lists.select("src", F.inline("entries")).select("src", F.col("base_path").alias("dst"))
    return targets.filter(is_followable(F.col("dst")))


def followable_links(items: DataFrame) -> DataFrame:
    """Distinct link targets worth following."""
    return followable_edges(items).select("dst").distinct()


def item_addresses(items: DataFrame) -> DataFrame:
    """requested_path, path of every item that exists (F2), one row per pair."""
    return (
        items.filter(F.col("list_from").isNull() & (F.coalesce("base_path", F.lit("")) != ""))
        .select("requested_path", F.col("base_path").alias("path"))
        .distinct()
    )


def resolved_links(items: DataFrame) -> DataFrame:
    """Distinct src, dst with redirects applied and links to missing items dropped.

    A popular target makes one join partition large; it is split at run time (AQE), which
    costs no extra shuffle because the distinct shuffles by both columns anyway.
    """
    followed = followable_edges(items).withColumnRenamed("dst", "requested_path")
    return followed.join(item_addresses(items), "requested_path").select("src", F.col("path").alias("dst")).distinct()
