"""The fetch frontier: new links, priorities and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.scoring import url_priority
from wayloom.operators.links import followable_edges, item_addresses, link_rows
from wayloom.operators.ranking import number_rows

BATCH_SIZE = 10
PART_LINKS = 2_000_000


def linked_pages(items: DataFrame, sources: DataFrame) -> DataFrame:
    """path of every page that the ``sources`` (path) link to, once each.

    Targets are made distinct before they are looked up, so a popular target is one row.
    """
    targets = (
        followable_edges(items)
        .join(sources.select(F.col("path").alias("src")), "src")
        .select(F.col("dst").alias("requested_path"))
        .distinct()
    )
    return targets.join(item_addresses(items), "requested_path").select("path").distinct()


def new_links(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Each candidate path once, unless it was seen before (J5). Exact, no filter errors."""
    return candidates.select("path").distinct().join(seen.select("path"), "path", "left_anti")


def links_beyond(items: DataFrame, pages: DataFrame) -> DataFrame:
    """depth, path: what the pages of each depth link to and no page of that depth or above is.

    ``pages`` has path and depth_level. Targets are made distinct for each depth before they
    are looked up, so a popular target is a row per depth. Where the links are too many for the
    session's shuffle partitions, they meet the pages in more of them, so that a task sorts its
    share in memory. Paths are made distinct where they meet the pages seen.
    """
    edges, sources = followable_edges(items), pages.select(F.col("path").alias("src"), F.col("depth_level").alias("depth"))
    parts = math.ceil((items.agg(F.sum(link_rows(F.col("links")))).first()[0] or 0) / PART_LINKS)
    if parts > int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        edges, sources = edges.repartition(parts, "src"), sources.repartition(parts, "src")
    targets = edges.join(sources, "src").select("depth", F.col("dst").alias("requested_path")).distinct()
    linked = targets.join(item_addresses(items), "requested_path").select("depth", "path")
    seen = pages.groupBy("path").agg(F.min("depth_level").alias("seen"))
    beyond = linked.join(seen, "path", "left").filter("seen IS NULL OR seen > depth")
    return beyond.select("depth", "path").distinct()


def frontier(pages: DataFrame) -> DataFrame:
    """section, path, depth, priority of rows that have path, content_type, depth_level."""
    return pages.select(
        "section", "path",
        F.col("depth_level").alias("depth"),
        url_priority(F.col("path"), F.col("content_type"), F.col("depth_level")).alias("priority"),
    )


def next_batch(queue: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The first ``batch_size`` rows by priority, path, depth (K5)."""
    return queue.orderBy("priority", "path", "depth").limit(batch_size)


def frontier_batches(queue: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The whole queue with its ``batch`` number per section, from 0 (K6)."""
    numbered = number_rows(queue, ["section"], ["priority", "path", "depth"], "place")
    batch = F.floor((F.col("place") - 1) / F.lit(batch_size)).cast("bigint")
    return numbered.select("section", "path", "depth", "priority", batch.alias("batch"))
