"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into cells. Every shard owns ``virtual_nodes`` cells chosen by hash, a row's
key hashes to a cell, and the row belongs to the next virtual node clockwise. A shard takes no
more rows than its bound: rows that find it full continue clockwise to the next node whose
shard has room. With a load factor of 1 the bounds add up to the number of rows, so all shards
fill and their counts are at most one apart; a larger factor moves fewer rows when shards change.

Only the counts per cell (a fixed number of cells) reach the driver, which walks the ring over
them; the rows are numbered inside their cells. A cell is large only if very many rows have one
key; such a cell is cut by a hash of the columns that order it, and numbered part by part.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.tables import table

CELLS = 1 << 16
VIRTUAL_NODES = 256
CELL_ROWS, MAX_CUTS = 100_000, 100_000


def ring(spark, shards: int, virtual_nodes: int, cells: int) -> np.ndarray:
    """Owner of each virtual node's cell, -1 elsewhere; the lower shard keeps a cell two want."""
    shard = (F.col("id") / virtual_nodes).cast("long")
    nodes = spark.range(shards * virtual_nodes).select(
        F.pmod(F.xxhash64(F.lit("node"), shard, F.col("id") % virtual_nodes), F.lit(cells)).alias("cell"),
        shard.alias("shard"),
    )
    owners = np.full(cells, -1, dtype=np.int64)
    for row in nodes.groupBy("cell").agg(F.min("shard").alias("shard")).collect():  # at most a row a cell
        owners[row["cell"]] = row["shard"]
    return owners


def bounds(total: int, shards: int, load_factor: float) -> np.ndarray:
    """Rows each shard may hold."""
    if load_factor < 1:
        raise ValueError("a load factor below 1 has no room for all rows")
    least, extra = divmod(total, shards)
    tight = np.full(shards, least, dtype=np.int64)
    tight[:extra] += 1
    return np.maximum(tight, np.int64(np.ceil(load_factor * total / shards)) if load_factor > 1 else 0)


def walk(counts: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Parts (cell, first, last + 1, shard): which rows of a cell each shard takes.

    Each shard first takes what hashes to it, cell after cell, up to its bound. What is left
    over goes round the ring, first come first served.
    """
    cells = len(counts)
    nodes = np.flatnonzero(owners >= 0)
    if not len(nodes):
        raise ValueError("no virtual node")
    room = capacity.copy()
    following = nodes[np.searchsorted(nodes, np.arange(cells)) % len(nodes)]
    parts, left = [], {}
    for cell in np.flatnonzero(counts):
        shard = owners[following[cell]]
        taken = int(min(counts[cell], room[shard]))
        if taken:
            parts.append((int(cell), 0, taken, int(shard)))
            room[shard] -= taken
        if taken < counts[cell]:
            left.setdefault(int(following[cell]), []).append((int(cell), taken, int(counts[cell])))
    waiting: deque = deque()
    for _ in range(2):
        for node in nodes:
            waiting.extend(left.pop(int(node), ()))
            shard = owners[node]
            while waiting and room[shard]:
                cell, first, last = waiting.popleft()
                taken = int(min(last - first, room[shard]))
                parts.append((cell, first, first + taken, int(shard)))
                room[shard] -= taken
                if first + taken < last:
                    waiting.appendleft((cell, first + taken, last))
    assert not waiting and not left
    return parts


def _numbered(placed: DataFrame, counts: np.ndarray, order: list[Column], cell_rows: int) -> DataFrame:
    """The rows with ``__n``, their number in their cell from 0; large cells part by part."""
    least = max(cell_rows, int(counts.sum()) // MAX_CUTS)
    cuts = [(int(cell), -(-int(counts[cell]) // least)) for cell in np.flatnonzero(counts > least)]
    if not cuts:
        return placed.withColumn("__n", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)).cast("long") - 1)
    # At most MAX_CUTS parts of large cells and as many such cells.
    large = placed.sparkSession.createDataFrame(cuts, "__of long, __cuts int")
    part = F.coalesce(F.pmod(F.xxhash64(*order), F.col("__cuts")), F.lit(0))
    parted = placed.join(F.broadcast(large), F.col("__cell") == F.col("__of"), "left").withColumn("__part", part).drop("__of")
    earlier = Window.partitionBy("__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.filter("__cuts IS NOT NULL").groupBy("__cell", "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select(F.col("__cell").alias("__of"), F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__cell", "__part").orderBy(*order)
    found = parted.withColumn("__n", F.row_number().over(inside).cast("long") - 1)
    found = found.join(F.broadcast(before), (F.col("__cell") == F.col("__of")) & (F.col("__part") == F.col("__p")), "left")
    return found.withColumn("__n", F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__of", "__p", "__before", "__part", "__cuts")


def shard_rows(
    rows: DataFrame,
    *,
    key: str = "doc_id",
    order: tuple[str, ...] = (),
    shards: int = 40,
    virtual_nodes: int = VIRTUAL_NODES,
    load_factor: float = 1.0,
    cells: int = CELLS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All columns, and ``shard`` and ``slot``, the row's number in its shard, gapless from 0.

    Rows of one cell are ordered by its hash, ``key`` and ``order``; rows that agree in all of
    them may change places. In cells of more than ``cell_rows`` rows a hash of ``order`` goes
    before these. Null keys are one key. Columns named shard or slot give way. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    hashed = F.xxhash64(F.lit("row"), F.col(f"`{key}`"))
    placed = rows.select(*[F.col(f"`{c}`") for c in names], F.pmod(hashed, F.lit(cells)).alias("__cell"))
    counts = np.zeros(cells, dtype=np.int64)
    for row in placed.groupBy("__cell").count().collect():  # at most a row a cell
        counts[row["__cell"]] = row["count"]
    owners = ring(spark, shards, virtual_nodes, cells)
    parts = walk(counts, owners, bounds(int(counts.sum()), shards, load_factor))
    filled = [0] * shards
    listed = []
    for cell, first, last, shard in sorted(parts, key=lambda p: (p[3], p[0], p[1])):
        listed.append((cell, first, last, shard, filled[shard] - first))
        filled[shard] += last - first
    # At most two parts a cell and one more a shard.
    plan = spark.createDataFrame(listed, "__cell long, __first long, __last long, shard int, __base long")
    numbered = _numbered(placed, counts, [hashed, *[F.col(f"`{c}`") for c in (key, *order)]], cell_rows)
    return (
        numbered.join(F.broadcast(plan), (numbered["__cell"] == plan["__cell"]) & F.expr("__n >= __first AND __n < __last"))
        .select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("__n") + F.col("__base")).alias("slot"))
    )


def op8_sharding(spark, sf_dir):
    """All documents in 40 shards whose row counts are at most one apart."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
