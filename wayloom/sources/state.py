"""Crawl state as Parquet tables below one folder.

``levels/depth=k`` holds the pages found in round k, ``snapshots/depth=k`` one row that
says rounds 0 to k are whole. A round without its snapshot is written again on resume.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayloom.session import freed_shuffles

LEVELS = "path STRING, ord INT, is_new BOOLEAN, depth INT"
SNAPSHOTS = (
    "pages_processed BIGINT, sections_covered BIGINT, snapshots_due BIGINT, "
    "owner STRING, link_buckets INT, page_buckets INT, inputs STRING, depth INT"
)
DEFAULT_INTERVAL = 100


class CrawlState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._tables: dict[str, str] = {}
        # A bucket is one file, so joins by its key need not sort again what lies there sorted.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def bucketed(self, name: str, rows: DataFrame, key: str, buckets: int) -> DataFrame:
        """The rows in ``buckets`` by ``key``. Only a named table remembers its buckets, so it
        has a name until ``release``."""
        table = self._name(name)
        with freed_shuffles(self.spark):
            (
                rows.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
                .option("path", f"{self.path}/{name}").saveAsTable(table)
            )
        return self.spark.table(table)

    def reopen(self, name: str, columns: str, key: str, buckets: int) -> DataFrame:
        """A bucketed table of an earlier run, from its files."""
        table = self._name(name)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
            f"INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return self.spark.table(table)

    def _name(self, name: str) -> str:
        self._tables[name] = f"wayloom_{name.replace('/', '_').replace('=', '_')}_{uuid.uuid4().hex}"
        return self._tables[name]

    def release(self) -> None:
        """Forget the names of the bucketed tables; their files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def clear(self, *names: str) -> None:
        """Free the files of tables that nothing reads any more."""
        for name in names:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def save(self, name: str, rows: DataFrame) -> DataFrame:
        with freed_shuffles(self.spark):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.load(name, rows.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def save_level(self, depth: int, rows: DataFrame, buckets: int) -> tuple[DataFrame, int, int]:
        """Write one round, bucketed by path; returns it, its rows and how many of them are
        pages not met before.

        Both counts come with the write itself. They are taken above the last shuffle,
        where a task that runs again counts once.
        """
        counts = Observation()
        counted = rows.select("path", "ord", "is_new").observe(
            counts, F.count(F.lit(1)).alias("rows"), F.count_if("is_new").alias("pages")
        )
        level = self.bucketed(f"levels/depth={depth}", counted, "path", buckets)
        return level, counts.get["rows"], counts.get["pages"]

    def open_level(self, depth: int, buckets: int) -> DataFrame:
        return self.reopen(f"levels/depth={depth}", "path STRING, ord INT, is_new BOOLEAN", "path", buckets)

    def levels(self, first: int, last: int) -> DataFrame:
        """Pages of the rounds ``first`` to ``last``; other rounds are not read."""
        return self.load("levels", LEVELS).filter(F.col("depth").between(first, last))

    def save_snapshot(self, depth: int, interval: int, **facts) -> None:
        """``facts`` are the columns that describe the walk: owner, buckets, inputs."""
        pages = F.count_if("is_new")
        row = self.levels(0, depth).agg(
            pages.alias("pages_processed"),
            F.count_distinct("ord").alias("sections_covered"),
            F.floor(pages / F.lit(interval)).alias("snapshots_due"),
            *(F.lit(value).alias(name) for name, value in facts.items()),
        )
        row.write.mode("overwrite").parquet(f"{self.path}/snapshots/depth={depth}")

    def open(self) -> None:
        """Make the folder readable before its first snapshot; changes nothing later on."""
        names = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in SNAPSHOTS.split(", ")[:-1])]
        self.spark.range(0, 1, 1, 1).selectExpr(*names).write.mode("ignore").parquet(f"{self.path}/snapshots/depth=-1")

    def snapshots(self) -> DataFrame | None:
        """One row per snapshot, or None where the folder holds no state."""
        try:
            return self.load("snapshots", SNAPSHOTS).filter(F.col("depth") >= 0)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def last_snapshot(self):
        """Row of the deepest whole round, or None."""
        saved = self.snapshots()
        return None if saved is None else saved.orderBy(F.desc("depth")).first()


def snapshot_due(pages_before: int, pages_now: int, interval: int = DEFAULT_INTERVAL) -> bool:
    """True once ``interval`` pages have come in since the last snapshot."""
    return pages_now - pages_before >= interval
