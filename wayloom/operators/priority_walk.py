"""A walk in order of priority: rounds that take the best pages of a queue.

Each round takes the first ``batch_size`` pages of the queue by priority, path and depth, looks
their items up and adds what they link to, unless it was ever in the queue.

A step does many rounds at once. It takes the pages of the next rounds as if nothing came in
between, looks up what they link to and notes the round that finds each page. The rounds hold up
to the first one that a page found in an earlier round would have been in; what later ones found
is left out and found again. So a step does one round at least, and the more the fewer pages come
in before the queue's first. The driver sees one row per round of a step.

The queue lies in one bucket per priority. A bucket is sorted once; pages that come in later are
sorted in when a round gets to the first of them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.scoring import url_priority
from wayloom.operators.crawl import BUCKET_ROWS, LinkGraph, followed, link_sources, stage_graph
from wayloom.operators.frontier import BATCH_SIZE
from wayloom.operators.pages import page_records
from wayloom.operators.ranking import number_rows
from wayloom.session import fresh_dir
from wayloom.sources.state import CrawlState

JOINED_STEPS = 8
STEP_GROWTH = 8
STEP_ROUNDS = 4096
QUEUED = ("path", "depth", "priority")
ROUNDS = "path STRING, depth INT, priority INT, round INT, place BIGINT"


@dataclass
class Bucket:
    """The queued pages of one priority: ``run`` with its ``rank``s in order of path, of which
    ``gone`` have left, and the ``late`` ones, of which ``least`` is the first path."""

    run: DataFrame | None = None
    size: int = 0
    gone: int = 0
    late: list[DataFrame] = field(default_factory=list)
    n_late: int = 0
    least: str | None = None

    @property
    def left(self) -> int:
        return self.size - self.gone

    def add(self, rows: DataFrame, n: int, least: str) -> None:
        self.late.append(rows)
        self.n_late += n
        self.least = least if self.least is None else min(self.least, least)

    def sort(self, store: CrawlState, name: str) -> None:
        """All pages in one run."""
        rows = [self.run.filter(F.col("rank") > self.gone).select(*QUEUED)] if self.left else []
        ranked = number_rows(reduce(DataFrame.unionAll, rows + self.late), ["priority"], ["path"], "rank")
        run = store.save(name, ranked.select(*QUEUED, F.col("rank").cast("long").alias("rank")))
        self.run, self.size, self.gone = run, self.left + self.n_late, 0
        self.late, self.n_late, self.least = [], 0, None


def priority_walk(
    items: DataFrame,
    sections: DataFrame,
    *,
    batch_size: int = BATCH_SIZE,
    max_depth: int = 5,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """path, depth, priority, round (from 0) and place in the round (from 1) of every page reached.

    ``items`` and ``sections`` as for ``crawl``. A page enters the queue once, with the depth of
    the least deep page of the round that leads to it, plus one; the links of pages at
    ``max_depth`` are not looked at. The last round may be smaller.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    spark = items.sparkSession
    store = CrawlState(spark, fresh_dir(spark, "priority"))
    try:
        graph = stage_graph(items, store, bucket_rows)
        kinds = _kinds(items, store, graph)
        roots = sections.select(F.col("path").alias("requested_path"), F.lit(-1).alias("round"), F.lit(0).alias("depth"))
        entered = store.bucketed("entered/step=0", _found(roots, [], graph, kinds), "path", graph.pages)
        queue, seen, number, step, ahead = {}, [], 0, 0, 1
        while True:
            seen = _with(seen, entered, store, graph, step)
            # One row per priority.
            for row in entered.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least")).collect():
                part = entered.filter(F.col("priority") == row["priority"]).select(*QUEUED)
                queue.setdefault(row["priority"], Bucket()).add(part, row["n"], row["least"])
            if not queue:
                break
            step += 1
            parts, ends = _next_rounds(queue, batch_size, ahead, f"sorted/step={step}", store)
            taken = _taken(parts, batch_size, number, len(ends))
            found = _found(_targets(taken.filter(F.col("depth") < max_depth), graph), seen, graph, kinds)
            entered = store.bucketed(f"entered/step={step}", found, "path", graph.pages)
            firsts = entered.groupBy("round").agg(F.min(F.struct("priority", "path")).alias("first")).collect()
            done = _undisturbed(ends, [(row["round"] - number, tuple(row["first"])) for row in firsts])
            number += done
            store.save(f"rounds/step={step}", taken.filter(F.col("round") < number))
            entered = entered.filter(F.col("round") < number)
            for priority, bucket, before, take in parts:
                bucket.gone += max(0, min(take, done * batch_size - before))
                if not bucket.left and not bucket.late:
                    del queue[priority]
            ahead = min(STEP_GROWTH * done, STEP_ROUNDS)
    finally:
        store.release()
    if not number:
        return spark.createDataFrame([], ROUNDS)
    return store.load("rounds", ROUNDS).select(*QUEUED, "round", "place")


def _kinds(items: DataFrame, store: CrawlState, graph: LinkGraph) -> DataFrame:
    """path, content_type of every page, by its first address as in the page table."""
    first = page_records(items).groupBy("path").agg(F.min(F.struct("requested_path", "content_type")).alias("first"))
    return store.bucketed("kinds", first.select("path", "first.content_type"), "path", graph.pages)


def _targets(level: DataFrame, graph: LinkGraph) -> DataFrame:
    """requested_path, round, depth: the links of these pages by the first round that meets them."""
    sources = link_sources(level, graph, "round", "depth").withColumn("depth", F.col("depth") + 1)
    return _first(followed(sources, graph), F.col("dst"), "requested_path")


def _first(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """The key as ``name`` with the first round that meets it and the least depth there.

    Both are one number, which a hash aggregate takes; a struct would be sorted.
    """
    both = F.min(F.shiftleft(F.col("round").cast("long"), 32) + F.col("depth")).alias("both")
    return rows.groupBy(key.alias(name)).agg(both).select(
        name, F.shiftright("both", 32).cast("int").alias("round"), F.col("both").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("depth")
    )


def _found(targets: DataFrame, seen: list[DataFrame], graph: LinkGraph, kinds: DataFrame) -> DataFrame:
    """path, depth, priority, round of the pages at these addresses that were never seen.

    Pages are shuffled once; what was seen and the types are read where they lie.
    """
    found = _first(targets.join(graph.addresses, "requested_path"), F.col("path"), "path")
    for earlier in seen:
        found = found.join(earlier.select("path"), "path", "left_anti")
    priority: Column = url_priority(F.col("path"), F.col("content_type"), F.col("depth")).cast("int")
    return found.join(kinds, "path", "left").select("path", "depth", priority.alias("priority"), "round")


def _with(seen: list[DataFrame], entered: DataFrame, store: CrawlState, graph: LinkGraph, step: int) -> list[DataFrame]:
    """The tables of seen pages, merged into one when they have become many."""
    seen = [*seen, entered.select("path")]
    if len(seen) <= JOINED_STEPS:
        return seen
    merged = reduce(DataFrame.unionAll, seen)
    return [store.bucketed(f"seen/step={step}", merged, "path", graph.pages)]


def _next_rounds(queue: dict[int, Bucket], batch_size: int, ahead: int, name: str, store: CrawlState) -> tuple[list, list]:
    """The pages of the next rounds, at most ``ahead``, as (priority, bucket, place of its first
    page from 0, number of pages), and priority and path of the last page of each round.

    No late page comes before the last of them. A round that is not filled ends the queue.
    """
    sorts = 0
    while True:
        parts, total = [], 0
        for priority in sorted(queue):
            bucket = queue[priority]
            if not bucket.left:
                if total >= batch_size:
                    break
                bucket.sort(store, f"{name}/sort={sorts}")
                sorts += 1
            take = min(bucket.left, ahead * batch_size - total)
            parts.append((priority, bucket, total, take))
            total += take
            if total == ahead * batch_size:
                break
        ends = _ends(parts, batch_size)
        if total % batch_size and sum(bucket.left for bucket in queue.values()) == total:
            ends.append((math.inf, ""))
        late = [(priority, bucket) for priority, bucket, _, _ in parts if bucket.late]
        if late:
            del ends[bisect_left(ends, min((priority, bucket.least) for priority, bucket in late)):]
        if ends:
            return parts, ends
        late[0][1].sort(store, f"{name}/sort={sorts}")
        sorts += 1


def _ends(parts: list, batch_size: int) -> list[tuple[int, str]]:
    """Priority and path of the last page of each whole round, in order."""
    ends = []
    for priority, bucket, before, take in parts:
        place = F.col("rank") - F.lit(bucket.gone) + F.lit(before)
        rows = bucket.run.filter(F.col("rank").between(bucket.gone + 1, bucket.gone + take) & (place % batch_size == 0))
        ends += sorted((priority, row["path"]) for row in rows.select("path").collect())
    return ends


def _taken(parts: list, batch_size: int, number: int, rounds: int) -> DataFrame:
    """path, depth, priority, round, place of the pages of these rounds."""
    placed = []
    for _, bucket, before, take in parts:
        take = min(take, rounds * batch_size - before)
        if take > 0:
            rows = bucket.run.filter(F.col("rank").between(bucket.gone + 1, bucket.gone + take))
            placed.append(rows.withColumn("at", F.col("rank") - F.lit(bucket.gone + 1) + F.lit(before)))
    return reduce(DataFrame.unionAll, placed).select(
        *QUEUED,
        (F.floor(F.col("at") / F.lit(batch_size)) + F.lit(number)).cast("int").alias("round"),
        (F.col("at") % F.lit(batch_size) + 1).cast("long").alias("place"),
    )


def _undisturbed(ends: list, firsts: list) -> int:
    """How many rounds hold, by the first page that each of them (from 0) finds.

    A page found in one round would be in the next one, or in the first later one that ends
    behind it.
    """
    would_be_in = (max(number + 1, bisect_right(ends, first)) for number, first in firsts)
    return min([len(ends), *would_be_in])
