"""A whole scan: choose sections, walk, store the page table, analyse it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.times import duration_text
from wayloom.operators import crawl, pages, report, sections, trends
from wayloom.session import stored
from wayloom.sources.items import is_rate_limited
from wayloom.sources.state import DEFAULT_INTERVAL

DETAILS = ("standard", "detailed")


def scan(
    items: DataFrame,
    *,
    as_of: str | Column,
    names: str | None = None,
    max_depth: int = 5,
    owner: str = "first_section",
    excluded: Sequence[str] = (),
    detail: str = "standard",
    state: str | None = None,
    snapshot_every: int = DEFAULT_INTERVAL,
    fetch_log: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of one scan, by name, ready for ``exports.export``.

    The catalogue, the page table and its cells are stored once. All that counts pages reads the
    cells, so the page table is scanned once, however many analyses follow. Types
    are excluded after the walk, so links of excluded pages are still followed, and what
    counts the scan (metadata, sections and their depths, progress, text report) still counts
    them; the pages, their links, the trends with their histograms and the section reports
    don't. ``detail="detailed"`` adds the section reports.
    """
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {DETAILS}")
    chosen = choose_sections(items, names)
    walked = crawl.crawl(items, chosen, max_depth=max_depth, owner=owner, state=state, snapshot_every=snapshot_every)
    found = stored(pages.build_pages(walked, items, max_depth), "pages")
    cells = stored(trends.page_cells(found), "cells")
    kept, kept_cells = pages.exclude_types(found, excluded), pages.exclude_types(cells, excluded)
    types = cells.groupBy("content_type").agg(F.sum("n_pages").alias("n"))
    totals = _totals(cells, fetch_log)
    tables = {
        "catalogue": chosen,
        "cells": cells,
        "metadata": pages.scan_metadata(cells, max_depth, as_of),
        "sections": pages.section_rollup(cells),
        "section_depths": trends.depth_distribution(cells),
        "progress": _progress(cells, totals, types),
        "lines": report.report_lines(totals, types, as_of),
        "pages": kept,
        "page_links": pages.page_links(kept, items, max_depth),
        "trends": trends.section_trends(kept_cells, chosen, as_of),
        "type_distribution": trends.content_type_distribution(kept_cells),
        "depth_distribution": trends.depth_distribution(kept_cells),
        "org_distribution": trends.org_distribution(kept_cells),
    }
    if detail == "detailed":
        tables["reports"] = report.section_report_documents(kept_cells, chosen, as_of)
    return tables


def sample(items: DataFrame, names: str | None = None) -> dict[str, DataFrame]:
    """A quick look at the chosen sections from their root items only, without a walk."""
    chosen = choose_sections(items, names)
    return {"samples": sections.section_sample(chosen, items), "children": sections.section_children(chosen, items)}


def choose_sections(items: DataFrame, names: str | None = None) -> DataFrame:
    """The chosen sections; the items are read once for them, when the catalogue is stored."""
    catalogue = stored(sections.section_catalogue(items), "sections")
    return sections.select_sections(sections.require_sections(catalogue), names)


def _progress(cells: DataFrame, totals: DataFrame, types: DataFrame) -> DataFrame:
    """metric, item, n: the counters at the end of the scan, and its pages by type and depth."""
    names = ("sections_analyzed", "total_links_found", "rate_limit_hits")
    counters = totals.select(F.inline(F.array(*(
        F.struct(F.lit(name).alias("metric"), F.lit("").alias("item"), F.col(name).cast("bigint").alias("n")) for name in names
    ))))
    by_type = types.filter("content_type IS NOT NULL").select(F.lit("content_type").alias("metric"), F.col("content_type").alias("item"), "n")
    depths = cells.groupBy("depth_level").agg(F.sum("n_pages").alias("n"))
    by_depth = depths.select(F.lit("depth").alias("metric"), F.col("depth_level").cast("string").alias("item"), "n")
    return counters.unionByName(by_type).unionByName(by_depth)


def _totals(cells: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """The summary row of the report; refusals and duration need the fetch log."""
    totals = cells.agg(
        F.count_distinct("section").alias("sections_analyzed"),
        F.coalesce(F.sum("n_pages"), F.lit(0)).alias("total_links_found"),
    )
    if fetch_log is None:
        nothing = F.lit(None).cast("string")
        return totals.withColumns({"rate_limit_hits": F.lit(0), "scan_duration": nothing})
    span = F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))
    fetched = fetch_log.agg(
        F.count_if(is_rate_limited(F.col("http_status"))).alias("rate_limit_hits"),
        duration_text(span).alias("scan_duration"),
    )
    both = totals.unionByName(fetched, allowMissingColumns=True)
    return both.agg(*(F.max(name).alias(name) for name in both.columns))
