"""The given star-schema and event tables in the shape of content items and logs.

Lists of links are never collected: an item with many links is one head row
(``list_from`` null) and one continuation row per source row, so that a customer, nation or
order holding a third of all rows stays spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.schemas import LINKS

ROOT = "/browse"

# The columns in use; declared, so that opening a table costs no inference job.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, props STRING",
    "pages": "page_id BIGINT, url STRING",
}

# Every tenth customer is linked by an alias that redirects.
_CUSTOMER_LINK = "concat(if({0} % 10 = 0, '/c/', '/customer/'), {0})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


_ABSENT = "CAST(NULL AS STRING)"


def _link(target: str = _ABSENT, title: str = _ABSENT) -> str:
    return f"named_struct('title', {title}, 'base_path', {target})"


def _links(**lists: list[str]) -> str:
    entries = ", ".join(f"'{name}', array({', '.join(links)})" for name, links in lists.items())
    return f"map({entries})" if lists else f"CAST(NULL AS {LINKS})"


def _head(source: str, path: str, title: str, body: str, kind: str, links: str | None = None,
          updated_at: str = "''", requested: str | None = None) -> str:
    """The item's own document."""
    return f"""SELECT {requested or path} AS requested_path, {path} AS base_path, {title} AS title, {body} AS body,
        '{kind}' AS document_type, {_ABSENT} AS schema_name, {updated_at} AS updated_at,
        {links or _links()} AS links, {_ABSENT} AS error,
        CAST(NULL AS BIGINT) AS list_from FROM {source}"""


def _more(source: str, path: str, links: str, position: str, requested: str | None = None) -> str:
    """Further links of an item, one row per row of ``source``.

    The place is never null, so a query of the items' own documents skips these tables.
    """
    return f"""SELECT {requested or path}, {path}, NULL, NULL, NULL, NULL, NULL, {links}, NULL,
        coalesce(CAST({position} AS BIGINT), 0L) FROM {source}"""


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, orders and parts as linked items."""
    heads = [
        _head("range(1)", f"'{ROOT}'", "'Browse'", "'root'", "browse_page"),
        _head("{region}", "concat('/region/', r_regionkey)", "r_name", "r_name", "browse_page"),
        _head("{nation}", "concat('/nation/', n_nationkey)", "n_name", "n_name", "topic"),
        _head(
            "{customer}", "concat('/customer/', c_custkey)", "c_name", "if(c_acctbal < 0, '', c_mktsegment)",
            "detailed_guide", _links(organisations=[_link(title="c_mktsegment")]),
            requested=_CUSTOMER_LINK.format("c_custkey"),
        ),
        _head(
            "{supplier}", "concat('/supplier/', s_suppkey)", "s_name", "s_name", "service",
            _links(related=[_link("concat('/nation/', s_nationkey)")]),
        ),
        _head(
            "{orders}", "concat('/order/', o_orderkey)", "CAST(o_orderkey AS STRING)",
            "if(o_orderstatus <> 'P', o_orderstatus, NULL)", "transaction",
            _links(
                organisations=[_link(title="o_orderpriority")],
                related=[_link("concat('/assets/', o_orderkey, '.pdf')")],
            ),
            "CAST(o_orderdate AS STRING)",
        ),
        _head(
            "{part} WHERE p_partkey % 50 <> 0", "concat('/part/', p_partkey)", "p_name", "p_type", "guide",
            _links(organisations=[_link(title="p_brand")]),
        ),
    ]
    listings = [
        _more("{region}", f"'{ROOT}'", _links(children=[_link("concat('/region/', r_regionkey)", "r_name")]),
              "r_regionkey"),
        _more("{nation}", "concat('/region/', n_regionkey)",
              _links(children=[_link("concat('/nation/', n_nationkey)", "n_name")]), "n_nationkey"),
        _more("{customer}", "concat('/nation/', c_nationkey)",
              _links(children=[_link(_CUSTOMER_LINK.format("c_custkey"), "c_name")]), "c_custkey * 2"),
        _more("{supplier}", "concat('/nation/', s_nationkey)",
              _links(children=[_link("concat('/supplier/', s_suppkey)", "s_name")]), "s_suppkey * 2 + 1"),
        _more("{orders}", "concat('/customer/', o_custkey)",
              _links(related=[_link("concat('/order/', o_orderkey)")]), "o_orderkey",
              _CUSTOMER_LINK.format("o_custkey")),
        _more("{lineitem}", "concat('/order/', l_orderkey)",
              _links(related=[_link("concat('/part/', l_partkey)"), _link("concat('/supplier/', l_suppkey)")]),
              "l_linenumber * 2"),
    ]
    names = ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")
    return spark.sql(
        "\nUNION ALL ".join(heads + listings), **{name: table(spark, sf_dir, name) for name in names}
    )


def _path(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests with a fixed mix of outcomes."""
    slot = F.col("event_id") % 20
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("client"),
        _path("doc", "event_id").alias("requested_path"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(slot == 0, 404).when(slot == 1, 429).when(slot == 2, 500)
        .when(slot.isin(3, 4), F.lit(None)).otherwise(200).cast("int").alias("http_status"),
        F.when(slot == 5, F.lit("{bad")).otherwise(F.col("props")).alias("body"),
        F.when(slot == 3, F.lit("timeout")).when(slot == 4, F.lit("connection")).alias("transport_error"),
    )


def site_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a content API for regions, nations, suppliers and customers, as JSON bodies.

    Every item is asked for twice; the first answer is old and has no links. Some suppliers
    are gone by a later request, some bodies repeat a key, some have lists and entries that
    are no links, and some requests fail.
    """
    link = lambda path: f"concat('{{\"base_path\":\"', {path}, '\"}}')"
    body = lambda path, links: (
        f"concat('{{\"base_path\":\"', {path}, '\",\"title\":\"old\",\"title\":\"', {path}, '\",\"body\":\"b\",\"links\":{{', {links}, '}}}}')"
    )
    listed = lambda name, ids, path: (
        f"concat('\"{name}\":[', array_join(transform({ids}, x -> {link(path)}), ','), ']')"
    )
    nations = listed("children", "sequence(k * 5, k * 5 + 4)", "concat('/nation/', x)")
    suppliers = listed("children", "sequence(k, k + 175, 25)", "concat('/supplier/', x)")
    customers = f"concat({listed('related', 'sequence(k * 10, k * 10 + 9)', _CUSTOMER_LINK.format('x'))}, if(k % 7 = 0, ',\"odd\":[\"text\",3,{{\"base_path\":\"/region/0\"}}],\"note\":\"text\"', ''))"
    kinds = [
        ("region", "r_regionkey", "concat('/region/', k)", "concat('/region/', k)", nations),
        ("nation", "n_nationkey", "concat('/nation/', k)", "concat('/nation/', k)", suppliers),
        ("supplier", "s_suppkey", "concat('/supplier/', k)", "concat('/supplier/', k)", customers),
        ("customer", "c_custkey", _CUSTOMER_LINK.format("k"), "concat('/customer/', k)", "''"),
    ]
    parts = [
        table(spark, sf_dir, name).selectExpr(f"CAST({key} AS BIGINT) AS k", "explode(array(0, 1, 2)) AS n").selectExpr(
            f"{at} * 10000000000L + k * 10 + n AS request_id", f"{asked} AS requested_path", f"'{name}' AS kind", "k", "n",
            f"""CASE WHEN n = 0 THEN concat('{{"base_path":"', {path}, '","title":"first"}}') ELSE {body(path, links)} END AS body""",
        )
        for at, (name, key, asked, path, links) in enumerate(kinds)
    ]
    asked = reduce(DataFrame.unionAll, parts)
    gone = (F.col("kind") == "supplier") & (F.col("k") % 11 == 0)
    status = F.when(F.col("n") < 2, 200).when(gone, 404).otherwise(500)
    return asked.select(
        "request_id", F.col("kind").alias("client"), "requested_path",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")).alias("fetched_at"),
        status.cast("int").alias("http_status"), F.when(status == 200, F.col("body")).alias("body"),
        F.lit(None).cast("string").alias("transport_error"),
    )


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of the events in six ISO forms, one of them with a zone, and some that are none."""
    form = lambda pattern: F.date_format("ts", pattern)
    texts = [
        form("yyyy-MM-dd HH:mm:ss"), form("yyyyMMdd'T'HHmmss"), F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0100")),
        form("yyyy-MM-dd'T'HH"), form("yyyyMMdd"), F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit(",5")), form("yyyy-MM"),
    ]
    chosen = F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", chosen.alias("text"))


def queue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of many types, paths and depths, for the fetch queue."""
    event = F.col("event_id")
    area = F.when(event % 4 == 1, "/services/").when(event % 4 == 2, "/guidance/").otherwise("/doc/")
    kinds = F.array(*(F.lit(kind) for kind in ("guide", "detailed_guide", "service", "transaction", "topic")))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("section"),
        F.concat(area, event.cast("string")).alias("path"),
        F.element_at(kinds, (event % 5 + 1).cast("int")).alias("content_type"),
        (event % 97).cast("int").alias("depth_level"),
    )


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress reports; a user's first event starts its section."""
    events = table(spark, sf_dir, "events")
    first = (
        events.groupBy("user_id")
        .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
        .select("event_id", F.lit(True).alias("first"))
    )
    return events.join(first, "event_id", "left").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("user_id").cast("string").alias("section"),
        F.coalesce("first", F.lit(False)).alias("section_started"),
        F.lit(1).cast("bigint").alias("links_found"),
        (F.col("user_id") % 6).cast("int").alias("depth"),
        F.col("event_type").alias("content_type"),
        (F.col("event_type") == "error").alias("rate_limited"),
    )


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page table with many dates, sections and owners, for the trend operators."""
    user = F.col("user_id")
    org = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("org"), (user % 12).cast("string")))
    return table(spark, sf_dir, "events").select(
        (user % 10).cast("string").alias("section"),
        _path("doc", "event_id").alias("path"),
        F.col("event_type").alias("content_type"),
        F.col("ts").cast("string").alias("last_updated"),
        F.when(F.col("event_type") == "error", F.lit("placeholder")).otherwise(F.lit("active")).alias("status"),
        (user % 6).cast("int").alias("depth_level"),
        org.alias("publishing_org"),
        F.lit(0).cast("bigint").alias("related_links_count"),
    )
