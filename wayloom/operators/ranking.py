"""Row numbers per group that stay spread over tasks however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.session import fresh_dir


def number_rows(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, … per ``group`` in ascending ``order``, which must be unique.

    Rows are range-partitioned by group and order, sorted and written once, with an id that
    rises by one from row to row of a range. A row's number follows from its id, the first id of
    its group in that range and the sizes of the group's earlier ranges, so a group with a third
    of all rows is numbered by a third of the tasks and no row is shuffled or sorted again.
    """
    spark = rows.sparkSession
    ranges = f"{fresh_dir(spark, 'ranges')}"
    sorted_rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = sorted_rows.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    ranged.write.parquet(ranges)
    stored = spark.read.schema(ranged.schema).parquet(ranges)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_first"))
        .select(*group, "_range", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        stored.join(offsets, [*group, "_range"])
        .withColumn(name, F.col("_id") - F.col("_first") + 1 + F.col("_before"))
        .drop("_range", "_id", "_first", "_before")
    )
