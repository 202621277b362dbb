"""Trend aggregates per section over a page table.

``as_of`` is a column or literal text; no operator reads the clock.
Each aggregate reads its own one or two columns, so several of them over one stored page
table cost about one scan of it.

Every operator takes a page table or its cells (``page_cells``): one row for all pages that
are alike in section, type, depth, status and owner, with their number and the figures of
their dates. Cells of parts of a page table add up (``merge_cells``), and whatever is asked of
them later reads no page again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.times import DAY_MICROS, age_days, age_micros, floor_div, instant, iso_text, parse_iso

NO_UPDATES = "No update data available"
TOP_TYPES = 3
TOP_PUBLISHERS = 5


CELL = ("section", "content_type", "depth_level", "status", "publishing_org")


def page_cells(pages: DataFrame) -> DataFrame:
    """The cells of a page table: ``CELL``, n_pages, total_updates, oldest, newest, update_micros.

    The sum of the dates is a DECIMAL, which is exact.
    """
    updated = parse_iso(F.col("last_updated"))
    dated = pages.select(*CELL, updated.alias("updated"))
    return dated.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("updated").alias("total_updates"),
        F.min("updated").alias("oldest"),
        F.max("updated").alias("newest"),
        F.sum(F.unix_micros("updated").cast("decimal(20,0)")).alias("update_micros"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of several parts of a page table as those of the whole."""
    sums = [F.sum(name).alias(name) for name in ("n_pages", "total_updates")]
    dates = [F.min("oldest").alias("oldest"), F.max("newest").alias("newest")]
    micros = F.sum("update_micros").cast("decimal(30,0)").alias("update_micros")
    return cells.groupBy(*CELL).agg(*sums, *dates, micros)


def _is_cells(pages: DataFrame) -> bool:
    return "n_pages" in pages.columns


def number(pages: DataFrame) -> Column:
    """Sum of the pages in the rows of a group."""
    return F.sum("n_pages") if _is_cells(pages) else F.count(F.lit(1))


def update_patterns(pages: DataFrame, as_of: str | Column) -> DataFrame:
    """Oldest and newest update, how many, and the age in full days of the mean one (A1, K4).

    Ages add up as DECIMAL: a double sum of microseconds is inexact from 2^53 on.
    """
    now = instant(as_of)
    if _is_cells(pages):
        of_now = F.sum("total_updates").cast("decimal(20,0)") * F.unix_micros(now).cast("decimal(17,0)")
        sums = pages.groupBy("section").agg(
            F.min("oldest").alias("oldest"),
            F.max("newest").alias("newest"),
            F.sum("total_updates").alias("total_updates"),
            (of_now - F.sum("update_micros").cast("decimal(37,0)")).cast("decimal(30,0)").alias("ages"),
        )
    else:
        dated = pages.select("section", parse_iso(F.col("last_updated")).alias("updated"))
        sums = dated.groupBy("section").agg(
            F.min("updated").alias("oldest"),
            F.max("updated").alias("newest"),
            F.count("updated").alias("total_updates"),
            F.sum(age_micros(now, F.col("updated")).cast("decimal(20,0)")).alias("ages"),
        )
    whole = floor_div(F.col("ages"), F.col("total_updates").cast("decimal(20,0)") * DAY_MICROS)
    return sums.select(
        "section",
        iso_text(F.col("oldest")).alias("oldest_update"),
        iso_text(F.col("newest")).alias("newest_update"),
        "total_updates",
        F.when(F.col("total_updates") > 0, whole.cast("double")).alias("average_age_days"),
        age_days(now, F.col("newest")).alias("newest_age_days"),
        F.when(F.col("total_updates") == 0, F.lit(NO_UPDATES)).alias("error"),
    )


def content_type_distribution(pages: DataFrame) -> DataFrame:
    """section, content_type, n (A2)."""
    kind = F.coalesce("content_type", F.lit("unknown")).alias("content_type")
    return pages.groupBy("section", kind).agg(number(pages).alias("n"))


def content_type_totals(pages: DataFrame) -> DataFrame:
    """section, total_types (A2); counts the histogram's rows, which is distinct already."""
    return content_type_distribution(pages).groupBy("section").agg(F.count(F.lit(1)).alias("total_types"))


def depth_distribution(pages: DataFrame) -> DataFrame:
    """section, depth_level, n (A3)."""
    depth = F.coalesce("depth_level", F.lit(0)).alias("depth_level")
    return pages.groupBy("section", depth).agg(number(pages).alias("n"))


def depth_metrics(pages: DataFrame) -> DataFrame:
    """section, max_depth, average_depth (A3)."""
    depth = F.coalesce("depth_level", F.lit(0))
    total = F.sum(depth * F.col("n_pages")) if _is_cells(pages) else F.sum(depth)
    return pages.groupBy("section").agg(
        F.greatest(F.lit(0), F.max(depth)).alias("max_depth"),
        (total / number(pages)).alias("average_depth"),
    )


def org_distribution(pages: DataFrame) -> DataFrame:
    """section, publishing_org, n; pages without an owner are left out."""
    owned = pages.filter(F.coalesce("publishing_org", F.lit("")) != "")
    return owned.groupBy("section", "publishing_org").agg(number(pages).alias("n"))


def org_totals(pages: DataFrame) -> DataFrame:
    """section, total_organisations (A4); sections without any owner count 0."""
    owner = F.nullif(F.col("publishing_org"), F.lit("")).alias("publishing_org")
    per_owner = pages.groupBy("section", owner).agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("section").agg(F.count("publishing_org").alias("total_organisations"))


def most_common(counts: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` largest groups per section with their ``rank``; ties go by value.

    Spark keeps only ``k`` rows per section in each task before it shuffles.
    """
    order = Window.partitionBy("section").orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_content_types(pages: DataFrame, k: int = TOP_TYPES) -> DataFrame:
    return most_common(content_type_distribution(pages), "content_type", k)


def top_publishers(pages: DataFrame, k: int = TOP_PUBLISHERS) -> DataFrame:
    return most_common(org_distribution(pages), "publishing_org", k)


def primary_owner(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """section, publishing_org, n of the largest owner; nulls where there is none (K3)."""
    first = top_publishers(pages, 1).select("section", "publishing_org", "n")
    return sections.select(F.col("path").alias("section")).join(first, "section", "left")


def join_trends(sections: DataFrame, pages: DataFrame, as_of: str | Column) -> DataFrame:
    """``sections``, which has a column ``section``, with the figures of all four analyses.

    Sections are read once and keep their other columns; those without pages get zeros.
    """
    figures = (update_patterns(pages, as_of), content_type_totals(pages), depth_metrics(pages), org_totals(pages))
    joined = reduce(lambda left, right: left.join(right, "section", "left"), figures, sections)
    counts = ("total_updates", "total_types", "max_depth", "total_organisations")
    no_updates = F.coalesce("total_updates", F.lit(0)) == 0
    return joined.withColumns(
        {
            **{name: F.coalesce(name, F.lit(0)) for name in counts},
            "average_depth": F.coalesce("average_depth", F.lit(0.0)),
            "error": F.when(no_updates, F.lit(NO_UPDATES)),
        }
    )


def section_trends(pages: DataFrame, sections: DataFrame, as_of: str | Column) -> DataFrame:
    """One row per section with the four analyses; empty sections too."""
    return join_trends(sections.select(F.col("path").alias("section")), pages, as_of)
