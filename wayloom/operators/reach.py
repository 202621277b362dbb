"""Every section that reaches a page, with the page's depth in it (J3, state per section and page).

All sections walk at once. A page carries a bitmap of the sections that reach it, 64 to a row,
and a level is a ``bit_or`` over the links: a page costs one row for each level at which some
section comes upon it first, however many do, and a popular target is one row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.crawl import BUCKET_ROWS, LinkGraph, followed, link_sources, stage_graph
from wayloom.session import fresh_dir
from wayloom.sources.state import CrawlState

WORD_BITS = 64


def section_reach(items: DataFrame, sections: DataFrame, *, max_depth: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """section, path, depth_level: every section with every page within ``max_depth`` links of it.

    ``items`` and ``sections`` as for ``crawl``; the numbers (``ord``) of sections are unique
    and not negative. A section without its item reaches nothing.
    """
    store = CrawlState(items.sparkSession, fresh_dir(items.sparkSession, "reach"))
    roots = store.save("roots", sections.select("ord", F.col("path").alias("section")))
    try:
        graph = stage_graph(items, store, bucket_rows)
        level = _save(store, 0, _roots(roots, graph), graph)
        seen = level
        for depth in range(1, max_depth + 1):
            if level.isEmpty():
                break
            level = _save(store, depth, next_bits(level, seen, graph), graph)
            if depth < max_depth:
                seen = store.bucketed(f"seen/depth={depth}", _merged(seen, level), "page", graph.pages)
    finally:
        store.release()
    found = store.load("bits", "page STRING, path STRING, word INT, bits BIGINT, depth INT")
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda bit: F.getbit("bits", bit) == 1)
    reached = found.select("path", F.col("depth").alias("depth_level"), "word", F.explode(held).alias("bit"))
    return (
        reached.select("path", "depth_level", (F.col("word") * WORD_BITS + F.col("bit")).alias("ord"))
        .join(roots, "ord").select("section", "path", "depth_level")
    )


def _save(store: CrawlState, depth: int, rows: DataFrame, graph: LinkGraph) -> DataFrame:
    return store.bucketed(f"bits/depth={depth}", rows, "page", graph.pages)


def _page(path: Column, word: Column) -> Column:
    """One key for a page and a word of its bitmap; no path holds a line end."""
    return F.concat(path, F.lit("\n"), word.cast("string"))


def _keyed(found: DataFrame) -> DataFrame:
    """page, path, word, bits with one row per page and word."""
    merged = found.select(_page(F.col("path"), F.col("word")).alias("page"), "path", "word", "bits")
    return merged.groupBy("page").agg(
        F.first("path").alias("path"), F.first("word").alias("word"), F.bit_or("bits").alias("bits")
    )


def _roots(roots: DataFrame, graph: LinkGraph) -> DataFrame:
    word = F.floor(F.col("ord") / WORD_BITS).cast("int").alias("word")
    bits = F.expr(f"shiftleft(1L, CAST(ord % {WORD_BITS} AS INT))").alias("bits")
    starts = roots.select(F.col("section").alias("requested_path"), word, bits)
    return _keyed(starts.join(graph.addresses, "requested_path"))


def next_bits(level: DataFrame, seen: DataFrame, graph: LinkGraph) -> DataFrame:
    """page, path, word, bits: what the sections of ``level`` come upon one link further.

    Only bits that ``seen`` hasn't are kept. Targets and then pages are shuffled once; links,
    addresses and what was seen are read where they lie.
    """
    targets = (
        followed(link_sources(level, graph, "word", "bits"), graph)
        .groupBy(F.col("dst").alias("requested_path"), "word").agg(F.bit_or("bits").alias("bits"))
    )
    found = _keyed(targets.join(graph.addresses, "requested_path"))
    before = seen.select("page", F.col("bits").alias("known"))
    fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))
    return found.join(before, "page", "left").withColumn("bits", fresh).filter("bits <> 0").drop("known")


def _merged(seen: DataFrame, level: DataFrame) -> DataFrame:
    """Both bitmaps of each page in one row; the two tables are bucketed alike, so nothing moves."""
    new = level.select("page", F.col("path").alias("p"), F.col("word").alias("w"), F.col("bits").alias("b"))
    return seen.join(new, "page", "full").select(
        "page", F.coalesce("path", "p").alias("path"), F.coalesce("word", "w").alias("word"),
        F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("b", F.lit(0))).alias("bits"),
    )
