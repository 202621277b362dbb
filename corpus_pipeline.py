"""The corpus pipeline: five stages over ``documents``, each a written table the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import decontamination, language, line_dedup, near_join, packing
from wayloom.llm.tables import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; dictionaries come from the labelled ones."""
    judged = language.identify(docs, language.fit(docs), min_score=language.MIN_SCORE)
    return judged.filter("NOT rejected").select(*COLUMNS)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; one made of nothing else stays whole.

    Near copies count once, or a large group of them would lose the lines it has in common.
    """
    classes = written(line_dedup.like_texts(docs), "line-classes")
    cleaned = line_dedup.drop_site_lines(docs, classes=classes, keep_emptied=True)
    return cleaned.select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS]
    )


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_join.keep_one_of_each(docs).select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    judged = decontamination.screen(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return judged.filter("NOT contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their ids."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_site_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_contaminated),
    ("packing", pack),
]

# Compression sizes, minhashes and token ids have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
