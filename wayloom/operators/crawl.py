"""Depth-limited walk of the link graph from section roots.

The walk goes level by level. Each level is one join of the pages found last with the
links, one lookup of the targets and one look at the pages of each level so far.

Which section owns a page, ``owner``:

``first_section``  the lowest section that reaches the page within the depth limit, with
                   the page's depth in that section;
``nearest``        the lowest section among those that reach it at the least depth.

One row per page is enough for both. For ``first_section`` a page found again is worth
following only if a lower section found it: whatever a higher section reaches through
the page later, the lower one has reached in as many steps or fewer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayloom.operators.links import followable_edges, item_addresses, link_rows
from wayloom.session import fresh_dir
from wayloom.sources.state import DEFAULT_INTERVAL, CrawlState, snapshot_due

OWNERS = ("first_section", "nearest")
BUCKET_ROWS = 2_000_000
SMALL_BUCKET_ROWS = 100_000
MAX_BUCKETS = 100_000
MAX_HUBS = 100_000
HUB_CELLS = 65_536
JOINED_LEVELS = 8
MARKS = ("rows", "high", "middle", "low")
MARK_BITS = 22


@dataclass(frozen=True)
class LinkGraph:
    """Links and where they lead, laid out so that a level moves only what it finds.

    ``edges`` (src_part, dst) are bucketed by ``src_part``, the source and the number of its
    part; only ``hubs`` (src, copies) have more than part 0. ``addresses`` are bucketed by
    requested_path into ``pages``, the number of partitions that aggregates shuffle to.
    ``mark`` tells the items it was made from.
    """

    edges: DataFrame
    addresses: DataFrame
    hubs: DataFrame
    buckets: int
    pages: int
    mark: str = ""


def crawl(
    items: DataFrame,
    sections: DataFrame,
    *,
    max_depth: int = 5,
    owner: str = "first_section",
    state: str | None = None,
    snapshot_every: int = DEFAULT_INTERVAL,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """section, path, depth_level of every page within ``max_depth`` links of a section.

    ``items`` has the shape of ``CONTENT_ITEMS``, ``sections`` that of ``SECTIONS``. With a
    ``state`` folder the walk saves a snapshot at every level that brings the pages since the
    last one to ``snapshot_every``, and one at its end; where the folder holds snapshots it
    goes on from the deepest one. A state of other items, sections or owner is refused.
    Without one nobody can go on, so the links it laid out are freed at its end.

    ``bucket_rows`` is the number of links a bucket may hold; hubs and parts follow from it.
    """
    if owner not in OWNERS:
        raise ValueError(f"owner must be one of {OWNERS}")
    if snapshot_every < 1:
        raise ValueError("snapshot_every must be at least 1")
    spark = items.sparkSession
    store = CrawlState(spark, state or fresh_dir(spark, "crawl"))
    last = None
    if state:
        store.open()
        last = store.last_snapshot()
    if last and last.owner != owner:
        raise ValueError(f"the state in {store.path} was made with owner={last.owner}")

    roots = sections.select("ord", F.col("path").alias("section"))
    of_roots = _mark_of(_first_row(roots, F.xxhash64("ord", "section"))) if state else ""
    made_from = f"{_mark_of(_first_row(items, _item_hash()))} {of_roots}" if last else ""
    if last and last.inputs != made_from:
        raise ValueError(f"the state in {store.path} was made from other items or sections")
    try:
        if last:
            roots = store.load("roots", roots.schema)
            graph = open_graph(store, last.link_buckets, last.page_buckets)
            levels = [store.open_level(depth, graph.pages) for depth in range(last.depth + 1)]
            depth, fresh, pages, saved_pages = last.depth, None, last.pages_processed, last.pages_processed
        else:
            roots = store.save("roots", roots)
            graph = stage_graph(items, store, bucket_rows, marked=bool(state))
            made_from = f"{graph.mark} {of_roots}"
            depth, saved_pages = 0, 0
            level, fresh, pages = store.save_level(0, _root_level(roots, graph.addresses), graph.pages)
            levels = [level]

        facts = {"owner": owner, "link_buckets": graph.buckets, "page_buckets": graph.pages, "inputs": made_from}
        while True:
            ending = fresh == 0 or depth >= max_depth
            due = ending or snapshot_due(saved_pages, pages, snapshot_every)
            if state and due and (last is None or depth > last.depth):
                store.save_snapshot(depth, snapshot_every, **facts)
                saved_pages = pages
            if ending:
                break
            found = next_level(levels, graph, owner == "first_section")
            depth += 1
            level, fresh, new_pages = store.save_level(depth, found, graph.pages)
            levels.append(level)
            pages += new_pages
    finally:
        store.release()
    if not state:
        store.clear("links", "addresses")

    owned = _owned_pages(store.levels(0, min(depth, max_depth)), owner)
    return owned.join(roots, "ord").select("section", "path", "depth_level")


def _row_marks(row_hash: Column) -> list[Column]:
    """Number of rows and sum of their hashes, which no order and no repeated row can hide.

    The sum is kept as those of three pieces of 22 bits, 64-bit numbers that hold 2^41 rows.
    """
    piece = F.lit((1 << MARK_BITS) - 1)
    pieces = {
        "high": F.shiftright(row_hash, 2 * MARK_BITS),
        "middle": F.shiftright(row_hash, MARK_BITS).bitwiseAND(piece),
        "low": row_hash.bitwiseAND(piece),
    }
    return [F.count(F.lit(1)).alias("rows"), *(F.sum(value).alias(name) for name, value in pieces.items())]


def _first_row(rows: DataFrame, row_hash: Column) -> Mapping:
    return rows.agg(*_row_marks(row_hash)).first().asDict()


def _item_hash() -> Column:
    return F.xxhash64("requested_path", "base_path", "list_from", F.map_entries("links"))


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in MARKS]


def _mark_of(sums: Mapping) -> str:
    rows, high, middle, low = (sums[name] or 0 for name in MARKS)
    return f"{rows}:{(((high << MARK_BITS) + middle) << MARK_BITS) + low}"


def stage_graph(items: DataFrame, store: CrawlState, bucket_rows: int = BUCKET_ROWS, marked: bool = False) -> LinkGraph:
    """Bucket the links by source and the addresses by request, once for all levels.

    A source with more links than an eighth of a bucket is a hub: its links are spread by
    target over several parts. A hub has more than 1/MAX_HUBS of all links, so there are
    fewer than MAX_HUBS of them, and their list, empty or not, is safe to broadcast.

    Links are counted by cells of a hash, of which few rows are shuffled; only the sources in a
    cell that is as large as a hub are counted one by one. ``marked`` asks for the items' mark.
    """
    spark = items.sparkSession
    share = max(1, bucket_rows // 8)
    counted = Observation()
    cell, n = F.pmod(F.xxhash64("base_path"), F.lit(HUB_CELLS)), F.sum(link_rows(F.col("links"))).alias("n")
    # Taken above the shuffle, where a task that runs again counts once.
    facts = [F.sum("n").alias("links"), F.count_if(F.col("n") > share).alias("large"), *(_sums() if marked else [])]
    cells = items.groupBy(cell.alias("cell")).agg(n, *(_row_marks(_item_hash()) if marked else [])).observe(counted, *facts)
    large_cells = store.save("large_cells", cells.filter(F.col("n") > share).select("cell"))
    suspects = items.join(F.broadcast(large_cells), cell == F.col("cell")) if counted.get["large"] else items.limit(0)
    degrees = suspects.groupBy(F.col("base_path").alias("src")).agg(n)
    large = store.save("hubs", degrees.filter(F.col("n") > share))
    total = counted.get["links"] or 0
    mark = _mark_of(counted.get) if marked else ""
    hubs = store.save("hubs_in_use", _copies(large, max(share, total // MAX_HUBS), share))
    at_hand = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(at_hand, math.ceil(total / SMALL_BUCKET_ROWS)), math.ceil(total / bucket_rows))
    buckets = min(buckets, MAX_BUCKETS)
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("copies")), F.lit(0))
    parts = followable_edges(items).join(F.broadcast(hubs), "src", "left").select(
        _src_part(F.col("src"), part).alias("src_part"), "dst"
    )
    edges = store.bucketed("links", parts.repartition(buckets, "src_part"), "src_part", buckets)
    addresses = item_addresses(items).repartition(at_hand, "requested_path")
    return LinkGraph(edges, store.bucketed("addresses", addresses, "requested_path", at_hand), hubs, buckets, at_hand, mark)


def open_graph(store: CrawlState, buckets: int, pages: int) -> LinkGraph:
    """The graph of an earlier run, from its files."""
    return LinkGraph(
        store.reopen("links", "src_part STRING, dst STRING", "src_part", buckets),
        store.reopen("addresses", "requested_path STRING, path STRING", "requested_path", pages),
        store.load("hubs_in_use", "src STRING, copies INT"), buckets, pages,
    )


def _src_part(src: Column, part: Column) -> Column:
    """One key for a source and a part of its links; no path holds a line end."""
    return F.concat(src, F.lit("\n"), part.cast("string"))


def _copies(large: DataFrame, floor: int, share: int) -> DataFrame:
    return large.filter(F.col("n") > floor).select("src", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("copies"))


def link_sources(level: DataFrame, graph: LinkGraph, *facts: str) -> DataFrame:
    """src_part and the ``facts`` of each page of a level, once for each part of its links."""
    last_copy = F.coalesce("copies", F.lit(1)) - 1
    return (
        level.select(F.col("path").alias("src"), *facts).join(F.broadcast(graph.hubs), "src", "left")
        .select("src", *facts, F.explode(F.sequence(F.lit(0), last_copy)).alias("part"))
        .select(_src_part(F.col("src"), F.col("part")).alias("src_part"), *facts)
    )


def followed(sources: DataFrame, graph: LinkGraph) -> DataFrame:
    """The links of these ``link_sources`` with their facts.

    Buckets are sorted by source, and their files are read between the first and the last of
    the sources only.
    """
    low, high = sources.agg(F.min("src_part"), F.max("src_part")).first()
    return sources.join(graph.edges.filter(F.col("src_part").between(F.lit(low), F.lit(high))), "src_part")


def next_level(levels: list[DataFrame], graph: LinkGraph, improve: bool) -> DataFrame:
    """Pages one link beyond the last of ``levels``: path, ord, is_new.

    A page counts if it is in none of them or, with ``improve``, if a lower section than
    any before found it. Targets and then pages are shuffled once; links, addresses and
    earlier levels are read where they lie.
    """
    targets = (
        followed(link_sources(levels[-1], graph, "ord"), graph)
        .groupBy(F.col("dst").alias("requested_path"))
        .agg(F.min("ord").alias("found"))
    )
    found = targets.join(graph.addresses, "requested_path").groupBy("path").agg(F.min("found").alias("ord"))
    known = []
    for seen in _seen(levels):
        known.append(f"known_{len(known)}")
        found = found.join(seen.select("path", F.col("ord").alias(known[-1])), "path", "left")
    least = F.least(*known) if len(known) > 1 else F.col(known[0])
    wanted = least.isNull() | (F.col("ord") < least) if improve else least.isNull()
    return found.filter(wanted).select("path", "ord", least.isNull().alias("is_new"))


def _seen(levels: list[DataFrame]) -> list[DataFrame]:
    """The last levels one by one; those before, of very deep walks, with one row per page."""
    old, last = levels[:-JOINED_LEVELS], levels[-JOINED_LEVELS:]
    if not old:
        return last
    merged = reduce(DataFrame.unionAll, [level.select("path", "ord") for level in old])
    return [merged.groupBy("path").agg(F.min("ord").alias("ord")), *last]


def _root_level(roots: DataFrame, addresses: DataFrame) -> DataFrame:
    """Pages of the sections themselves; a missing root leaves its section empty."""
    return (
        roots.join(addresses, roots.section == addresses.requested_path)
        .groupBy("path")
        .agg(F.min("ord").alias("ord"))
        .withColumn("is_new", F.lit(True))
    )


def _owned_pages(levels: DataFrame, owner: str) -> DataFrame:
    if owner == "nearest":
        return levels.select("path", "ord", F.col("depth").alias("depth_level"))
    # A page comes back only with a lower section, so its last round holds its owner.
    return levels.groupBy("path").agg(F.min("ord").alias("ord"), F.max("depth").alias("depth_level"))
