"""Merkle dataset manifest: trees of digests as postorder append logs, and proofs from them.

The rows of a source are the leaves of a tree in which 16 consecutive nodes become one. Aligned
builders get 4096 consecutive leaves each, the subtree of one node three levels up, and append
nodes in the order in which they are complete: children first, a node with its last leaf. The
roots of these blocks are the leaves of the next stage, until a tree has one block. The roots of
all sources are the leaves of one more tree, built alike.

Where a node stands in such a log follows from the sizes of the subtrees before it, so a proof
addresses the siblings of a leaf without a search. Blocks of all stages have at most 4096 leaves
and about 4400 nodes, whatever the size of a source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import table, written
from wayloom.operators.ranking import number_rows

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
DIGEST = 32
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<slot: int, siblings: binary>>"
LOG = "tree string, block long, leaves int, nodes binary"


def combined(children: bytes) -> bytes:
    """Digest of a node; its children's digests go in as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


def width(level: int, leaves: int) -> int:
    """Nodes of a level."""
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    """The level of the root."""
    level = 0
    while width(level, leaves) > 1:
        level += 1
    return level


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place of a node in the log of a tree of that many leaves, whose root is at level ``top``.

    With the node's last leaf all nodes below it are complete, and above it those that end
    before that leaf.
    """
    end = min((index + 1) * ARITY**level, leaves)
    below = sum(width(lower, end) for lower in range(level))
    above = sum((end - 1) // ARITY**upper for upper in range(level + 1, top + 1))
    return below + index + above


def block_log(leaves: list[bytes], top: int = LEVELS) -> list[bytes]:
    """The nodes of one block in the order in which they are complete, up to level ``top``."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def append(node: bytes, level: int) -> None:
        log.append(node)
        runs[level].append(node)
        if len(runs[level]) == ARITY and level < top:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        append(combined(b"".join(run)), level + 1)

    for leaf in leaves:
        append(leaf, 0)
    for level in range(top):
        if runs[level]:
            close(level)
    return log


def own_path(nodes: bytes, index: int, leaves: int, top: int) -> list[tuple[int, bytes]]:
    """For each level of a block, the slot of a leaf's ancestor in its run and the siblings there."""
    found = []
    for level in range(top):
        first = index - index % ARITY
        others = [at for at in range(first, min(first + ARITY, width(level, leaves))) if at != index]
        places = [DIGEST * position(level, at, leaves, top) for at in others]
        found.append((index - first, b"".join(nodes[at : at + DIGEST] for at in places)))
        index //= ARITY
    return found


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and the siblings on its path lead to."""
    for slot, siblings in path:
        digest = combined(siblings[: DIGEST * slot] + digest + siblings[DIGEST * slot :])
    return digest


def _build_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    nodes = b"".join(block_log(rows["digest"].to_pylist()))
    return pa.table({
        "tree": rows["tree"].slice(0, 1), "block": rows["block"].slice(0, 1),
        "leaves": pa.array([rows.num_rows], pa.int32()), "nodes": pa.array([nodes], pa.binary()),
    })


def append_logs(leaves: DataFrame) -> list[DataFrame]:
    """Tables (tree, block, leaves, nodes, alone), one for each stage: the blocks of all trees.

    ``leaves`` has tree, place from 0 and digest. ``alone`` says that a tree ends with its only
    block; such a block's log ends with the tree's root, those of others at the level of blocks.
    """
    stages: list[DataFrame] = []
    while True:
        placed = leaves.select("tree", "place", "digest", F.floor(F.col("place") / BLOCK).alias("block"))
        built = written(placed.groupBy("tree", "block").applyInArrow(_build_block, LOG), "merkle-blocks")
        # A block with a later one has company; only trees of more than BLOCK leaves have such.
        large = built.filter("block > 0").select(F.col("tree").alias("of")).distinct()
        marked = built.join(large, F.col("tree") == F.col("of"), "left").withColumn("alone", F.col("of").isNull()).drop("of")
        # The nodes over the root of a block that is a whole tree are the last of its log.
        level = F.lit(LEVELS)
        for lower in reversed(range(LEVELS)):
            level = F.when(F.col("leaves") <= ARITY**lower, lower).otherwise(level)
        surplus = F.when(F.col("alone"), LEVELS - level).otherwise(0)
        kept = F.expr("CAST(substring(nodes, 1, octet_length(nodes) - surplus) AS BINARY)")
        stages.append(written(marked.withColumn("surplus", surplus * DIGEST).withColumn("nodes", kept).drop("surplus"), "merkle-log"))
        leaves = stages[-1].filter("NOT alone").select("tree", F.col("block").alias("place"), _last_node().alias("digest"))
        if leaves.isEmpty():
            return stages


def _last_node() -> Column:
    return F.expr(f"CAST(substring(nodes, -{DIGEST}, {DIGEST}) AS BINARY)")


def tree_roots(stages: list[DataFrame]) -> DataFrame:
    """tree, root: each tree ends at one of the stages."""
    ends = [stage.filter("alone").select("tree", _last_node().alias("root")) for stage in stages]
    found = ends[0]
    for end in ends[1:]:
        found = found.unionAll(end)
    return found


def _paths(leaves: pa.Table, log: pa.Table) -> pa.Table:
    """The leaves of one block with the paths from them to the end of the log above it."""
    nodes, count, alone, above = (log[name][0].as_py() for name in ("nodes", "leaves", "alone", "above"))
    top = height(count) if alone else LEVELS
    rest = [(step["slot"], step["siblings"]) for step in above or []]
    paths = [own_path(nodes, place % BLOCK, count, top) + rest for place in leaves["place"].to_pylist()]
    steps = [[{"slot": slot, "siblings": siblings} for slot, siblings in path] for path in paths]
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.binary())]))
    return leaves.drop_columns(["block"]).append_column("path", pa.array(steps, kind))


def _judged(leaves: pa.Table, log: pa.Table) -> pa.Table:
    """The leaves of one block with their proofs, and the roots that these lead to."""
    nodes, count, alone, above, subroot, root = (log[name][0].as_py() for name in ("nodes", "leaves", "alone", "above", "subroot", "root"))
    top = height(count) if alone else LEVELS
    rest = [(step["slot"], step["siblings"]) for step in above or []]
    proofs, ends = [], []
    for place, leaf in zip(leaves["place"].to_pylist(), leaves["shown"].to_pylist(), strict=True):
        path = own_path(nodes, place % BLOCK, count, top) + rest
        proofs.append(b"".join(siblings for _, siblings in path))
        ends.append(folded(leaf, path))
    size = len(proofs)
    return leaves.select(["key", "digest"]).append_column("subroot", pa.array([subroot] * size, pa.binary())).append_column(
        "root", pa.array([root] * size, pa.binary())
    ).append_column("siblings", pa.array(proofs, pa.binary())).append_column("folded_root", pa.array(ends, pa.binary()))


def _above(stages: list[DataFrame], ends: DataFrame) -> list[DataFrame]:
    """tree, block, above for the blocks of each stage: the path from a block's root upwards.

    ``ends`` has tree and above for the roots of the trees.
    """
    found: list[DataFrame] = []
    higher = None
    for stage in reversed(stages):
        paths = stage.filter("alone").select("tree", "block").join(ends, "tree")
        if higher is not None:
            blocks = stage.filter("NOT alone").select("tree", F.col("block").alias("place"), F.floor(F.col("block") / BLOCK).alias("block"))
            led = blocks.groupBy("tree", "block").cogroup(higher.groupBy("tree", "block")).applyInArrow(_paths, f"tree string, place long, path {PATH}")
            paths = paths.unionAll(led.select("tree", F.col("place").alias("block"), F.col("path").alias("above")))
        found.insert(0, written(paths, "merkle-paths"))
        higher = stage.join(found[0], ["tree", "block"])
    return found


def prove(leaves: DataFrame) -> DataFrame:
    """key, digest, subroot, root, siblings, folded_root for each leaf.

    ``leaves`` has key, tree, digest, ``shown``, the digest that is to be proved, and ``place``
    from 0 in the tree. Trees are ordered by name, bytewise; ``siblings`` are the digests that
    a proof needs one after the other, ``folded_root`` what they make of ``shown``.
    """
    stages = append_logs(leaves.select("tree", "place", "digest"))
    roots = written(tree_roots(stages), "merkle-roots")
    ranked = number_rows(roots.withColumn("all", F.lit("")), ["all"], ["tree"], "place")
    sources = written(ranked.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"), (F.col("place") - 1).cast("long").alias("place")), "merkle-sources")
    tops = append_logs(sources.select("tree", "place", "digest"))
    last = tree_roots(tops).first()
    if last is None:
        return leaves.select("key", "digest", *(F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "siblings", "folded_root")))
    # The paths from the sources' roots to the one root, then those from blocks to their source's root.
    nothing = leaves.sparkSession.createDataFrame([("", [])], f"tree string, above {PATH}")
    over = tops[0].join(_above(tops, nothing)[0], ["tree", "block"])
    blocks = sources.select("tree", "place", "source", "digest", F.floor(F.col("place") / BLOCK).alias("block"))
    led = blocks.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInArrow(
        _paths, f"tree string, place long, source string, digest binary, path {PATH}"
    )
    ends = written(led.select(F.col("source").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot")), "merkle-ends")
    logs = stages[0].join(_above(stages, ends.select("tree", "above"))[0], ["tree", "block"])
    logs = logs.join(ends.select("tree", "subroot"), "tree").withColumn("root", F.lit(bytes(last["root"])))
    rows = leaves.withColumn("block", F.floor(F.col("place") / BLOCK))
    kind = leaves.schema["key"].dataType.simpleString()
    return rows.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInArrow(
        _judged, f"key {kind}, digest binary, subroot binary, root binary, siblings binary, folded_root binary"
    )


def log_nodes(stages: list[DataFrame]) -> DataFrame:
    """tree, position, level, index, digest: the whole logs, node by node."""
    sizes = stages[0].groupBy("tree").agg(F.sum("leaves").cast("long").alias("size"))
    kind = "tree string, position long, level int, index long, digest binary"
    found = None
    for number, stage in enumerate(stages):

        def nodes(batches, base=number * LEVELS):
            for batch in batches:
                for row in batch.to_pylist():
                    top = height(row["leaves"]) if row["alone"] else LEVELS
                    out = []
                    for level in range(1 if base else 0, top + 1):  # a higher stage's leaves are in the one below
                        for at in range(width(level, row["leaves"])):
                            index = row["block"] * ARITY ** (LEVELS - level) + at
                            own = DIGEST * position(level, at, row["leaves"], top)
                            place = position(base + level, index, row["size"], height(row["size"]))
                            out.append((row["tree"], place, base + level, index, row["nodes"][own : own + DIGEST]))
                    columns = zip(*out, strict=True) if out else [[]] * 5
                    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "position", "level", "index", "digest"])

        rows = stage.join(sizes, "tree").mapInArrow(nodes, kind)
        found = rows if found is None else found.unionAll(rows)
    return found


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of one row: for each field its UTF-8 bytes, a colon and its value, or - if null."""
    texts = [field.cast("string") for field in fields]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*shown), 256))


def document_leaves(documents: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", fields=FIELDS, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """Leaves for ``prove``: one tree per source, a null source before all others; places by key.

    Where ``tamper_every`` divides the crc32 of the key, ``shown`` is the digest with A-Z of the
    text in lower case. Null keys come first; rows that are equal have equal digests in any
    order; other columns than ``fields`` are not read. No rows give no rows.
    """
    columns = {name: F.col(f"`{name}`") for name in fields}
    digest = leaf_digest(list(columns.values()))
    lowered = leaf_digest([F.translate(c, UPPER, LOWER) if name == text else c for name, c in columns.items()])
    chosen = F.crc32(columns[key].cast("string").cast("binary")) % tamper_every == 0
    tree = F.coalesce(F.concat(F.lit("s"), columns[source]), F.lit("n"))
    rows = documents.select(
        columns[key].alias("key"), tree.alias("tree"), digest.alias("digest"), F.when(chosen, lowered).alias("altered")
    ).select("key", "tree", "digest", F.coalesce("altered", "digest").alias("shown"))
    numbered = number_rows(written(rows, "merkle-leaves"), ["tree"], ["key", "digest"], "place")
    return written(numbered.withColumn("place", (F.col("place") - 1).cast("long")), "merkle-placed")


def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf, roots and proof, and whether it still proves with its text as shown."""
    proved = prove(document_leaves(table(spark, sf_dir, "documents")))
    siblings = F.coalesce(F.lower(F.hex("siblings")), F.lit(""))
    return proved.select(
        F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(a) for c, a in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))],
        F.sha2(siblings, 256).alias("proof_sha256"), F.lower(F.hex("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


# Level by level to the root, and up again from every leaf; crc32 over the ASCII digits of the id.
ORACLE = rf"""
WITH RECURSIVE b0 AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)),
b1 AS (FROM b0 UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM b1 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM b1 WHERE k = 8),
x AS (SELECT DISTINCT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM documents, crc WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, source, text, coalesce(h % {TAMPER_EVERY} = 0, false) AS chosen, translate(text, '{UPPER}', '{LOWER}') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents LEFT JOIN x USING (doc_id)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN chosen THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS shown FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
s(tree, l, i, h) AS (SELECT tree, 0, i, leaf FROM p
  UNION ALL SELECT tree, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM s) WHERE c > 1 GROUP BY tree, l, i // 16),
subs AS (SELECT tree, max_by(h, l) AS h, max(l) AS l FROM s GROUP BY tree),
o AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM subs),
u(l, i, h) AS (SELECT 0, i, h FROM o
  UNION ALL SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY l, i // 16),
runs AS (SELECT tree, l, i // 16 AS run, list(h ORDER BY i) AS hs FROM s JOIN (SELECT tree, l AS top FROM subs) USING (tree) WHERE l < top GROUP BY tree, l, i // 16),
tops AS (SELECT l, i // 16 AS run, list(h ORDER BY i) AS hs FROM u WHERE l < (SELECT max(l) FROM u) GROUP BY l, i // 16),
f AS (SELECT r, tree, 0 AS l, i, shown AS h, '' AS proof FROM p
  UNION ALL SELECT f.r, f.tree, f.l + 1, f.i // 16,
    sha256(array_to_string(hs[:f.i % 16], '') || f.h || array_to_string(hs[f.i % 16 + 2:], '')),
    proof || array_to_string(hs[:f.i % 16], '') || array_to_string(hs[f.i % 16 + 2:], '')
  FROM f JOIN runs ON runs.tree = f.tree AND runs.l = f.l AND runs.run = f.i // 16),
g AS (SELECT f.r, 0 AS l, o.i, f.h, f.proof FROM f JOIN subs ON subs.tree = f.tree AND subs.l = f.l JOIN o ON o.tree = f.tree
  UNION ALL SELECT g.r, g.l + 1, g.i // 16,
    sha256(array_to_string(hs[:g.i % 16], '') || g.h || array_to_string(hs[g.i % 16 + 2:], '')),
    proof || array_to_string(hs[:g.i % 16], '') || array_to_string(hs[g.i % 16 + 2:], '')
  FROM g JOIN tops ON tops.l = g.l AND tops.run = g.i // 16),
root AS (SELECT max_by(h, l) AS root, max(l) AS top FROM u)
SELECT doc_id, leaf, subs.h AS subroot, root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = root AS verified
FROM p JOIN subs USING (tree) JOIN g USING (r) JOIN root ON g.l = root.top
"""
