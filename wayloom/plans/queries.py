"""The registered queries: one callable per operator, (spark, folder) to DataFrame.

Every query runs over the whole tables of the folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import content, scoring, times
from wayloom.operators import crawl as walk
from wayloom.operators import frontier, heartbeats, links, pages, progress, rates, reach, report, sections, trends
from wayloom.operators import priority_walk as by_priority
from wayloom.plans import inputs
from wayloom.plans.inputs import AS_OF, MAX_DEPTH
from wayloom.plans.scan import choose_sections, sample
from wayloom.session import fresh_dir
from wayloom.sources import exports, items, testdata
from wayloom.sources.state import CrawlState
from wayloom.streaming import landing
from wayloom.streaming import progress as live

Query = Callable[[SparkSession, str], DataFrame]

URL_BASE = "https://content.example.org/api/content"
CHOSEN_SECTIONS = "AMERICA, /region/3"
PREFERRED_SECTIONS = ("ASIA", "EUROPE")
EXCLUDED_TYPES = ("transaction", "topic")
HOUR_MICROS = 3_600_000_000
WALK_BATCH = 4_000


# Items and links

def page_records(spark, sf_dir):
    return pages.page_records(inputs.items(spark, sf_dir)).select("path", "content_type", "last_updated")


def page_status(spark, sf_dir):
    return pages.page_records(inputs.items(spark, sf_dir)).select("path", "status")


def publishing_orgs(spark, sf_dir):
    return pages.page_records(inputs.items(spark, sf_dir)).select("path", F.col("publishing_org").alias("org"))


def related_links(spark, sf_dir):
    return links.link_counts(inputs.items(spark, sf_dir))


def link_edges(spark, sf_dir):
    return links.link_edges(inputs.items(spark, sf_dir))


def followable_links(spark, sf_dir):
    return links.followable_links(inputs.items(spark, sf_dir))


def resolved_links(spark, sf_dir):
    return links.resolved_links(inputs.items(spark, sf_dir))


def build_urls(spark, sf_dir):
    records = pages.page_records(inputs.items(spark, sf_dir))
    return records.select("path", content.content_url(F.col("path"), URL_BASE).alias("url"))


def section_of_path(spark, sf_dir):
    raw = testdata.table(spark, sf_dir, "pages")
    return raw.select("url", content.section_of_path(F.col("url")).alias("section"))


# Sections

def section_catalogue(spark, sf_dir):
    return sections.require_sections(sections.section_catalogue(inputs.items(spark, sf_dir)))


def select_sections(spark, sf_dir):
    return choose_sections(inputs.items(spark, sf_dir), CHOSEN_SECTIONS)


def section_priority(spark, sf_dir):
    catalogue = sections.section_catalogue(inputs.items(spark, sf_dir))
    return sections.prioritise_sections(catalogue, PREFERRED_SECTIONS)


def section_sample(spark, sf_dir):
    return sample(inputs.items(spark, sf_dir))["samples"]


def section_children(spark, sf_dir):
    return sample(inputs.items(spark, sf_dir))["children"]


# The walk

def _crawl(spark, sf_dir, *, max_depth=MAX_DEPTH, **options):
    source = inputs.items(spark, sf_dir)
    return walk.crawl(source, sections.section_catalogue(source), max_depth=max_depth, **options)


def crawl_pages(spark, sf_dir):
    return _crawl(spark, sf_dir)


def crawl_nearest(spark, sf_dir):
    return _crawl(spark, sf_dir, owner="nearest")


def section_reach(spark, sf_dir):
    """Every section with every page it reaches, not the owner alone."""
    source = inputs.items(spark, sf_dir)
    return reach.section_reach(source, sections.section_catalogue(source), max_depth=MAX_DEPTH)


def crawl_resumed(spark, sf_dir):
    """Two levels first, then the rest from the saved state."""
    state = fresh_dir(spark, "state")
    _crawl(spark, sf_dir, max_depth=2, state=state)
    return _crawl(spark, sf_dir, state=state)


def crawl_snapshots(spark, sf_dir):
    """The snapshots that a walk leaves when every new page is reason enough for one."""
    state = fresh_dir(spark, "state")
    _crawl(spark, sf_dir, state=state, snapshot_every=1)
    return CrawlState(spark, state).snapshots().select("depth", "pages_processed", "snapshots_due")


# The page table

def page_table(spark, sf_dir):
    source = inputs.items(spark, sf_dir)
    return pages.build_pages(crawl_pages(spark, sf_dir), source, MAX_DEPTH)


def section_rollup(spark, sf_dir):
    return pages.section_rollup(inputs.pages(spark, sf_dir))


def scan_metadata(spark, sf_dir):
    return inputs.site(spark, sf_dir)["metadata"]


def page_links(spark, sf_dir):
    return inputs.site(spark, sf_dir)["page_links"]


def scan_progress_site(spark, sf_dir):
    return inputs.site(spark, sf_dir)["progress"]


def export_json(spark, sf_dir):
    """The pages as the JSON sink writes them, read again."""
    stored, path = inputs.pages(spark, sf_dir), fresh_dir(spark, "json")
    exports.export(inputs.site(spark, sf_dir), path, "json", exports.GZIP)
    return spark.read.schema(stored.schema).json(f"{path}/pages")


def published_tables(spark, sf_dir):
    """How many rows each JSON table of the last published run has, read through its manifest."""
    path = fresh_dir(spark, "published")
    exports.publish(inputs.site(spark, sf_dir), path, "json")
    found = [rows.select(F.lit(name).alias("name")) for name, rows in exports.published(spark, path).items()]
    return reduce(DataFrame.unionAll, found).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def export_csv(spark, sf_dir):
    """The flat pages as the CSV sink writes them, read again."""
    stored, path = pages.export_columns(inputs.pages(spark, sf_dir)), fresh_dir(spark, "csv")
    exports.export(inputs.site(spark, sf_dir), path, "csv")
    back = spark.read.schema(stored.schema).option("header", True).csv(path)
    return back.fillna("", ["last_updated", "publishing_org"])


def exclude_types(spark, sf_dir):
    kept = pages.exclude_types(inputs.pages(spark, sf_dir), EXCLUDED_TYPES)
    return kept.select("section", "path", "content_type")


def export_pages_flat(spark, sf_dir):
    return pages.export_columns(inputs.pages(spark, sf_dir))


# Frontier

def url_priority(spark, sf_dir):
    score = scoring.url_priority(F.col("path"), F.col("content_type"), F.col("depth_level"))
    return inputs.pages(spark, sf_dir).select("path", score.alias("priority"))


def url_priority_events(spark, sf_dir):
    return frontier.frontier(testdata.queue_pages(spark, sf_dir)).select("path", "priority")


def frontier_new(spark, sf_dir):
    """For each depth, the links of its pages that lead to pages not seen up to there."""
    return frontier.links_beyond(inputs.items(spark, sf_dir), inputs.pages(spark, sf_dir))


def _queue(spark, sf_dir):
    return frontier.frontier(inputs.pages(spark, sf_dir))


def priority_walk(spark, sf_dir):
    """The whole site in rounds of the best pages of the queue."""
    source = inputs.items(spark, sf_dir)
    found = by_priority.priority_walk(source, sections.section_catalogue(source), batch_size=WALK_BATCH, max_depth=MAX_DEPTH)
    return found.select("path", "depth", "priority", "round", "place")


def next_batch(spark, sf_dir):
    return frontier.next_batch(_queue(spark, sf_dir))


def frontier_batches(spark, sf_dir):
    return frontier.frontier_batches(_queue(spark, sf_dir))


def next_batch_events(spark, sf_dir):
    return frontier.next_batch(frontier.frontier(testdata.queue_pages(spark, sf_dir)))


def frontier_batches_events(spark, sf_dir):
    return frontier.frontier_batches(frontier.frontier(testdata.queue_pages(spark, sf_dir)))


# Trends and reports

def _on_pages(operator) -> Query:
    return lambda spark, sf_dir: operator(inputs.pages(spark, sf_dir))


def _on_events(operator) -> Query:
    return lambda spark, sf_dir: operator(testdata.event_pages(spark, sf_dir))


def _on_sections(operator, *args) -> Query:
    return lambda spark, sf_dir: operator(inputs.pages(spark, sf_dir), inputs.sections(spark, sf_dir), *args)


def _on_event_sections(operator, *args) -> Query:
    return lambda spark, sf_dir: operator(
        testdata.event_pages(spark, sf_dir), inputs.event_sections(spark, sf_dir), *args
    )


def _update_patterns(page_table):
    return trends.update_patterns(page_table, AS_OF)


def section_report_from_cells(spark, sf_dir):
    """The section reports again, from the stored cells of the scan alone."""
    return report.section_report(inputs.site(spark, sf_dir)["cells"], inputs.sections(spark, sf_dir), AS_OF)


def section_trends_from_cells_events(spark, sf_dir):
    """Trends from the merged cells of two halves of the events, as two levels of a scan leave them."""
    found = testdata.event_pages(spark, sf_dir)
    odd = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    halves = trends.page_cells(found.filter(odd)).unionByName(trends.page_cells(found.filter(~odd)))
    return trends.section_trends(trends.merge_cells(halves), inputs.event_sections(spark, sf_dir), AS_OF)


# Fetch log and progress

def classify_fetches(spark, sf_dir):
    return items.outcome_counts(testdata.fetch_log(spark, sf_dir))


def landed_items(spark, sf_dir):
    return items.items_from_fetches(testdata.fetch_log(spark, sf_dir)).select("requested_path", "base_path", "error")


def landed_stream(spark, sf_dir):
    """The items that a stream over the log's files has landed, in four batches."""
    source, target = fresh_dir(spark, "log"), fresh_dir(spark, "landing")
    testdata.fetch_log(spark, sf_dir).repartition(4, "request_id").write.parquet(source)
    landing.start_landing(landing.read_fetches(spark, source, 1), target, merge_every=2).awaitTermination()
    return landing.landed_items(spark, target).select("requested_path", "base_path", "error")


def crawl_from_fetches(spark, sf_dir):
    """The walk over what a log of API answers holds."""
    path = fresh_dir(spark, "landed")
    items.items_from_fetches(testdata.site_fetches(spark, sf_dir)).write.parquet(path)
    roots = testdata.table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS ord", "r_name AS title", "concat('/region/', r_regionkey) AS path"
    )
    return walk.crawl(items.read_items(spark, path), roots, max_depth=MAX_DEPTH)


def parsed_dates(spark, sf_dir):
    """Date texts of many forms as moments."""
    return testdata.date_texts(spark, sf_dir).select("event_id", times.iso_text(times.parse_iso(F.col("text"))).alias("moment"))


def rate_audit(spark, sf_dir):
    return rates.rate_audit(testdata.fetch_log(spark, sf_dir))


def rate_audit_hourly(spark, sf_dir):
    return rates.rate_audit(testdata.fetch_log(spark, sf_dir), limit=2, window_micros=HOUR_MICROS)


def scan_progress(spark, sf_dir):
    return progress.scan_progress(testdata.page_events(spark, sf_dir))


def progress_by_type(spark, sf_dir):
    return progress.progress_by_type(testdata.page_events(spark, sf_dir))


def progress_by_depth(spark, sf_dir):
    return progress.progress_by_depth(testdata.page_events(spark, sf_dir))


def scan_duration(spark, sf_dir):
    """How long each section took."""
    span = F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))
    return (
        testdata.page_events(spark, sf_dir).groupBy("section").agg(times.duration_text(span).alias("scan_duration"))
    )


def heartbeat_events(spark, sf_dir):
    """The heartbeats of a scan whose progress reports are the events."""
    return heartbeats.heartbeats(testdata.page_events(spark, sf_dir)).select("beat", "event_id", "elapsed")


def report_lines(spark, sf_dir):
    events = testdata.page_events(spark, sf_dir)
    return report.report_lines(progress.scan_progress(events), progress.progress_by_type(events), AS_OF)


def site_report_lines(spark, sf_dir):
    """The text report of the whole scan, with refusals and duration from the fetch log."""
    return inputs.site(spark, sf_dir)["lines"]


def progress_stream(spark, sf_dir):
    """The counters of the whole event table, kept by a stream over its stored files."""
    source, target = fresh_dir(spark, "events"), fresh_dir(spark, "progress")
    testdata.page_events(spark, sf_dir).write.parquet(source)
    live.start_progress(live.read_page_events(spark, source), target, heartbeat=None).awaitTermination()
    return progress.metrics_from_cells(live.latest_cells(spark, target))


def all_queries() -> dict[str, Query]:
    named = [
        page_records, page_status, publishing_orgs, related_links, link_edges, followable_links, resolved_links,
        build_urls, section_of_path,
        section_catalogue, select_sections, section_priority, section_sample, section_children,
        crawl_pages, crawl_nearest, section_reach, crawl_resumed, crawl_snapshots,
        page_table, section_rollup, scan_metadata, exclude_types, export_pages_flat,
        page_links, scan_progress_site, export_json, published_tables, export_csv,
        url_priority, url_priority_events, frontier_new, priority_walk,
        next_batch, next_batch_events, frontier_batches, frontier_batches_events,
        classify_fetches, landed_items, landed_stream, crawl_from_fetches, parsed_dates, rate_audit, rate_audit_hourly,
        scan_progress, progress_by_type, progress_by_depth, scan_duration, heartbeat_events, report_lines,
        site_report_lines, progress_stream, section_report_from_cells, section_trends_from_cells_events,
    ]
    registry: dict[str, Query] = {query.__name__: query for query in named}
    for name, operator in {
        "update_patterns": _update_patterns,
        "content_type_distribution": trends.content_type_distribution,
        "content_type_totals": trends.content_type_totals,
        "depth_distribution": trends.depth_distribution,
        "depth_metrics": trends.depth_metrics,
        "org_distribution": trends.org_distribution,
        "org_totals": trends.org_totals,
        "top_content_types": trends.top_content_types,
        "top_publishers": trends.top_publishers,
    }.items():
        registry[name] = _on_pages(operator)
        registry[f"{name}_events"] = _on_events(operator)
    for name, operator, args in (
        ("primary_owner", trends.primary_owner, ()),
        ("staleness_score", report.staleness_scores, (AS_OF,)),
        ("complexity_score", report.complexity_scores, ()),
        ("section_trends", trends.section_trends, (AS_OF,)),
        ("section_report", report.section_report, (AS_OF,)),
    ):
        registry[name] = _on_sections(operator, *args)
        registry[f"{name}_events"] = _on_event_sections(operator, *args)
    return registry
