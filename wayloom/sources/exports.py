"""Sinks: JSON documents, flat CSV and the text report."""

from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.pages import export_columns
from wayloom.session import freed_shuffles

FORMATS = ("json", "csv", "report", "analysis")
JSON_TABLES = ("metadata", "sections", "section_depths", "progress", "pages", "page_links")
ANALYSIS_TABLES = ("trends", "type_distribution", "depth_distribution", "org_distribution", "reports")
MANIFEST = "number BIGINT, folder STRING, format STRING, tables ARRAY<STRUCT<name: STRING, columns: STRING>>"
PLAIN, GZIP = "none", "gzip"

# A compressed file is read by one task, so none holds more rows.
GZIP_ROWS = 1_000_000


def _writer(rows: DataFrame, compression: str) -> DataFrameWriter:
    writer = rows.write.mode("overwrite").option("compression", compression)
    return writer if compression == PLAIN else writer.option("maxRecordsPerFile", GZIP_ROWS)


def write_json(rows: DataFrame, path: str, compression: str = PLAIN) -> None:
    """One JSON document per line, nested columns kept, nulls written out."""
    with freed_shuffles(rows.sparkSession):
        _writer(rows, compression).option("ignoreNullFields", "false").json(path)


def write_csv(pages: DataFrame, path: str, compression: str = PLAIN) -> bool:
    """Flat page rows with a header; no rows give a warning and no file."""
    if pages.isEmpty():
        warnings.warn("No data to write to CSV", stacklevel=2)
        return False
    _writer(export_columns(pages), compression).option("header", True).option("emptyValue", "").csv(path)
    return True


def write_report(lines: DataFrame, path: str, compression: str = PLAIN) -> None:
    """The lines in order; part files sort by name."""
    _writer(lines.orderBy("line_no", "line").select("line"), compression).text(path)


def output_path(folder: str, stamp: str, fmt: str) -> str:
    """Where an export of that format and time goes, e.g. ``data/content_20240201_000000.csv``."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return f"{folder.rstrip('/')}/content_{stamp}.{fmt}"


def export(tables: dict[str, DataFrame], path: str, fmt: str, compression: str = PLAIN) -> None:
    """Write the tables the format needs below ``path``.

    json      ``metadata``, ``sections``, ``section_depths``, ``progress``, ``pages`` and
              ``page_links`` as one folder each
    csv       ``pages``
    report    ``lines``
    analysis  ``trends``, the histograms of types, depths and organisations, and ``reports``
              as one folder each

    With ``compression="gzip"`` the same files end in ``.gz``; Spark reads both.
    """
    if fmt == "json":
        for name in JSON_TABLES:
            write_json(tables[name], f"{path}/{name}", compression)
    elif fmt == "csv":
        write_csv(tables["pages"], path, compression)
    elif fmt == "report":
        write_report(tables["lines"], path, compression)
    elif fmt == "analysis":
        for name in ANALYSIS_TABLES:
            write_json(tables[name], f"{path}/{name}", compression)
    else:
        raise ValueError(f"format must be one of {FORMATS}")


def publish(tables: dict[str, DataFrame], path: str, fmt: str, compression: str = GZIP) -> str:
    """Export into a new run folder below ``path`` and then make it the one that readers open.

    The manifest row is written last, so a reader sees all tables of one run: the one before
    until that row is there. One run is published to ``path`` at a time. Returns the folder.
    """
    spark = next(iter(tables.values())).sparkSession
    last = _last_run(spark, path)
    number = last["number"] + 1 if last else 1
    folder = f"run-{number}-{uuid.uuid4().hex}"
    export(tables, f"{path}/{folder}", fmt, compression)
    names = {"json": JSON_TABLES, "analysis": ANALYSIS_TABLES}.get(fmt, ())
    columns = [(name, tables[name].schema.toDDL()) for name in names]
    row = spark.createDataFrame([(number, folder, fmt, columns)], MANIFEST)
    row.drop("number").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number}")
    return f"{path}/{folder}"


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last run published to ``path``, by name: those of json and analysis,
    ``pages`` as text columns of a csv, ``lines`` of a report. Nothing published gives none."""
    last = _last_run(spark, path)
    if not last:
        return {}
    folder = f"{path}/{last['folder']}"
    if last["format"] == "csv":
        return {"pages": spark.read.option("header", True).option("emptyValue", "").csv(folder)}
    if last["format"] == "report":
        return {"lines": spark.read.text(folder)}
    return {table["name"]: spark.read.schema(table["columns"]).json(f"{folder}/{table['name']}") for table in last["tables"]}


def _last_run(spark: SparkSession, path: str):
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("number")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
