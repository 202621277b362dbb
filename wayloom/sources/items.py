"""Landed content items and fetch logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.schemas import CONTENT_ITEMS, DOCUMENT, FETCH_LOG, LINK
from wayloom.session import stored


def read_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed items with the declared schema, so no inference pass runs."""
    items = spark.read.schema(CONTENT_ITEMS).format(fmt).load(path)
    return items.withColumn("requested_path", F.coalesce("requested_path", "base_path"))


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FETCH_LOG).format(fmt).load(path)


# The outcomes of a fetch, as they appear in counts and reports.
TIMED_OUT, FAILED, NOT_FOUND, RATE_LIMITED, OK = "Request timed out", "Request failed", "not_found", "Rate limit exceeded", "ok"
BAD_JSON, TOO_LARGE = "Invalid JSON response from API", "Response too large to parse"

# Above this size the variant reader may give up on a good document.
MAX_BODY_BYTES = 16 << 20


def fetch_outcome(http_status: Column, body: Column, transport_error: Column, parsed: Column) -> Column:
    """``ok``, ``not_found`` or the error text of one response, whose body was ``parsed`` or not.

    A large body that can't be parsed is an outcome of its own: it may be good JSON.
    """
    return (
        F.when(transport_error == "timeout", F.lit(TIMED_OUT))
        .when(transport_error.isNotNull() | http_status.isNull(), F.lit(FAILED))
        .when(http_status == 404, F.lit(NOT_FOUND))
        .when(is_rate_limited(http_status), F.lit(RATE_LIMITED))
        .when(http_status >= 400, F.concat(F.lit("HTTP "), http_status.cast("string")))
        .when(~parsed & (F.octet_length(body) > MAX_BODY_BYTES), F.lit(TOO_LARGE))
        .when(~parsed, F.lit(BAD_JSON))
        .otherwise(F.lit(OK))
    )


def _has_body() -> Column:
    """True where the body decides the outcome; others are not parsed."""
    return F.col("transport_error").isNull() & (F.col("http_status") < 400)


def is_rate_limited(http_status: Column) -> Column:
    """Refused for too many requests."""
    return F.coalesce(http_status == 429, F.lit(False))


def _classified(fetch_log: DataFrame) -> DataFrame:
    """The log with ``doc``, ``large`` and ``outcome``.

    A body is parsed once, as a variant in which the last value of a repeated key counts. One
    that is too large for a variant becomes a map of its keys. Filters and projections above a
    generator use what it made, so they don't repeat its work.
    """
    spark, name = fetch_log.sparkSession, "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")  # read when the expression is analysed, here and now
    try:
        doc = F.when(_has_body(), F.try_parse_json("body"))
        parsed = fetch_log.select("*", F.explode(F.array(doc)).alias("doc"))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    unread = _has_body() & F.col("doc").isNull() & (F.octet_length("body") > MAX_BODY_BYTES)
    keys = F.from_json("body", "MAP<STRING, STRING>", {"maxStringLen": str((1 << 31) - 1)})
    parsed = parsed.select("*", F.explode(F.array(F.when(unread, keys))).alias("large"))
    readable = F.col("doc").isNotNull() | F.col("large").isNotNull()
    return parsed.withColumn("outcome", fetch_outcome(F.col("http_status"), F.col("body"), F.col("transport_error"), readable))


def classify_fetches(fetch_log: DataFrame) -> DataFrame:
    """The log with its ``outcome`` column."""
    return _classified(fetch_log).drop("doc", "large")


def outcome_counts(fetch_log: DataFrame) -> DataFrame:
    return classify_fetches(fetch_log).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def answers(fetch_log: DataFrame) -> DataFrame:
    """Good and not-found responses as items, with ``fetched_at`` and ``request_id``."""
    found = _classified(fetch_log).filter(F.col("outcome").isin(OK, NOT_FOUND))
    links = "coalesce(try_variant_get(doc, '$.links', 'variant'), try_parse_json(large['links'])) AS listed"
    fields = [f"coalesce(try_variant_get(doc, '$.{name}', 'string'), large['{name}']) AS {name}" for name in _SCALARS]
    return found.selectExpr("requested_path", "fetched_at", "request_id", "outcome", *fields, links).selectExpr(
        "requested_path", "fetched_at", "request_id", *_SCALARS, f"{_DOC_LINKS} AS links",
        f"CASE WHEN outcome = '{NOT_FOUND}' THEN outcome END AS error", "CAST(NULL AS BIGINT) AS list_from",
    )


def items_from_fetches(fetch_log: DataFrame) -> DataFrame:
    """Content items of the good and the not-found responses; failed requests drop out.

    Of several such responses to one request path the latest counts, the larger request id
    first at one instant: a later 404 takes a page away, a later failure doesn't.

    The answers are stored as they are parsed. Which of them counts is found from their keys
    alone; documents then meet a list of row numbers and are never sorted.
    """
    landed = stored(answers(fetch_log).withColumn("row", F.monotonically_increasing_id()), "answers")
    last = landed.groupBy("requested_path").agg(F.max(F.struct("fetched_at", "request_id", "row")).alias("last"))
    chosen = last.select("last.row")
    return landed.join(chosen.hint("shuffle_hash"), "row", "left_semi").drop("row", "fetched_at", "request_id")


_SCALARS = [field.split()[0] for field in DOCUMENT.split(", links ")[0].split(", ")]

# Lists of links by type. What is no list, and entries that are no documents, are left out; the
# others stay.
_DOC_LINKS = f"""
  transform_values(
    map_filter(
      transform_values(
        try_variant_get(listed, '$', 'map<string,variant>'),
        (kind, list) -> try_variant_get(list, '$', 'array<variant>')),
      (kind, list) -> list IS NOT NULL),
    (kind, list) -> filter(
      transform(list, entry -> try_variant_get(entry, '$', '{LINK}')), link -> link IS NOT NULL))"""
