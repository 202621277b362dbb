"""Connected components by contraction; every round is a pair of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, label) for all nodes of ``edges`` (columns a and b): the smallest node
    of the component is the label. Stars around their smallest node take one round."""
    edges = written(edges.filter("a <> b").distinct(), f"{label}-edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        steps.append(written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), f"{label}-step"))
        ends = steps[-1]
        moved = (
            edges.join(ends.toDF("a", "a2"), "a").join(ends.toDF("b", "b2"), "b")
            .filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        )
        edges = written(moved, f"{label}-edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps[0].toDF("node", "label")
    for ends in steps[1:]:
        found = found.join(ends.toDF("label", "next"), "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")
        )
    return written(found, label)
