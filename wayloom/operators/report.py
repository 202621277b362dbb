"""Section reports and the text report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.scoring import complexity_score, staleness_score
from wayloom.functions.times import instant, iso_text
from wayloom.operators.trends import (
    depth_metrics,
    join_trends,
    top_content_types,
    top_publishers,
    update_patterns,
)

UNKNOWN_TITLE = "Unknown Section"
REPORT_TITLE = "Content Mapping Report"


def staleness_scores(pages: DataFrame, sections: DataFrame, as_of: str | Column) -> DataFrame:
    """section, staleness_score (P13); only the dates are read."""
    ages = update_patterns(pages, as_of).select("section", "newest_age_days")
    joined = sections.select(F.col("path").alias("section")).join(ages, "section", "left")
    return joined.select("section", staleness_score(F.col("newest_age_days")).alias("staleness_score"))


def complexity_scores(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """section, complexity_score (P14); only the depths are read."""
    joined = sections.select(F.col("path").alias("section")).join(depth_metrics(pages), "section", "left")
    score = complexity_score(F.coalesce("max_depth", F.lit(0)), F.coalesce("average_depth", F.lit(0.0)))
    return joined.select("section", score.alias("complexity_score"))


def section_report(pages: DataFrame, sections: DataFrame, as_of: str | Column) -> DataFrame:
    """One flat row per section: trends, both scores and the primary owner."""
    titles = sections.select(
        F.col("path").alias("section"), F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("section_title")
    )
    owner = top_publishers(pages, 1).select(
        "section", F.col("publishing_org").alias("primary_owner"), F.col("n").alias("primary_owner_pages")
    )
    return (
        join_trends(titles, pages, as_of)
        .join(owner, "section", "left")
        .select(
            "section", "section_title",
            iso_text(instant(as_of)).alias("analysis_timestamp"),
            "oldest_update", "newest_update", "total_updates", "average_age_days", "error",
            staleness_score(F.col("newest_age_days")).alias("staleness_score"),
            "max_depth", "average_depth",
            complexity_score(F.col("max_depth"), F.col("average_depth")).alias("complexity_score"),
            "total_organisations", "primary_owner", "primary_owner_pages", "total_types",
        )
    )


def section_report_documents(pages: DataFrame, sections: DataFrame, as_of: str | Column) -> DataFrame:
    """The same as one nested document per section, for the JSON sink.

    Only the top lists are nested: they have at most 3 and 5 entries. The full
    histograms have no such bound and stay long tables.
    """
    flat = section_report(pages, sections, as_of)
    types = _ranked(top_content_types(pages), "content_type").withColumnRenamed("entries", "most_common")
    owners = _ranked(top_publishers(pages), "publishing_org").withColumnRenamed("entries", "primary_publishers")
    return (
        flat.join(types, "section", "left")
        .join(owners, "section", "left")
        .select(
            "section", "section_title", "analysis_timestamp",
            F.struct(
                F.struct("oldest_update", "newest_update", "total_updates", "average_age_days", "error")
                .alias("update_patterns"),
                "staleness_score",
            ).alias("content_freshness"),
            F.struct(
                F.struct("max_depth", "average_depth").alias("depth_patterns"), "complexity_score"
            ).alias("navigation_metrics"),
            F.struct(
                "total_organisations", "primary_publishers", "primary_owner", "primary_owner_pages"
            ).alias("content_ownership"),
            F.struct("total_types", "most_common").alias("type_analysis"),
        )
    )


def _ranked(top: DataFrame, value: str) -> DataFrame:
    entry = F.struct("rank", F.col(value).alias("value"), "n")
    return top.groupBy("section").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def report_lines(
    totals: DataFrame, by_type: DataFrame, generated: str | Column, title: str = REPORT_TITLE
) -> DataFrame:
    """line_no, line of the text report.

    ``totals`` is the one row of ``scan_progress``, ``by_type`` holds content_type, n. The
    type lines share the last number and sort by text.
    """
    text = lambda name, empty: F.coalesce(F.col(name).cast("string"), F.lit(empty))
    summary = [
        F.lit(title),
        F.lit("=" * 30),
        F.concat(F.lit("Generated: "), iso_text(instant(generated))),
        F.concat(F.lit("Duration: "), text("scan_duration", "N/A")),
        F.lit(""),
        F.lit("Summary"),
        F.lit("-" * 7),
        F.concat(F.lit("Sections analyzed: "), text("sections_analyzed", "0")),
        F.concat(F.lit("Total links found: "), text("total_links_found", "0")),
        F.concat(F.lit("Rate limit hits: "), text("rate_limit_hits", "0")),
        F.lit(""),
        F.lit("Content Types"),
        F.lit("-" * 12),
    ]
    head = totals.select(F.posexplode(F.array(*summary)).alias("line_no", "line")).select(
        (F.col("line_no") + 1).alias("line_no"), "line"
    )
    types = by_type.select(
        F.lit(len(summary) + 1).alias("line_no"),
        F.concat_ws(": ", F.col("content_type"), F.col("n").cast("string")).alias("line"),
    )
    return reduce(DataFrame.unionByName, (head, types))
