"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each set of word shingles gets, for every tree, a label of several minhashes. In a tree the
labels that start alike are a subtree of its prefix trie. The tries are not built: a join has
one threshold for all documents, so all labels are cut at one depth, the longest at which pairs
at the threshold meet in some tree with the target probability, whatever the data. That is
fixed banding, by a hash of tree and prefix. Documents with an equal one are candidates, those
that hang together are one group, and inside a group the Jaccard similarity of all pairs is
computed exactly from the sets. Only a pair that shares no prefix and isn't in one group by
way of others is lost: less than one in a million at the threshold, fewer above it.

Equal sets are one node with a number of copies. A group is cut into blocks and each pair of
blocks is a piece of work of bounded size; it returns a row per node (its links and a root),
never pairs. The exact number of links in a group of n different near copies costs n*n / 2
comparisons, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.components import components
from wayloom.llm.shingles import WordHashes, mixed, shingle_set
from wayloom.llm.tables import give_back, long_texts, table, written

SHINGLE_WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 48, 6, 0.999999
BLOCK = 256
SLAB = 4096

_RANDOM = np.random.Generator(np.random.PCG64(20_241))
FACTORS = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64)


def recall(threshold: float, trees: int, depth: int) -> float:
    """Probability that a pair at the threshold shares a prefix of that depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def match_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """The longest prefix that reaches the target recall."""
    depth = max_depth
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minhashes of non-empty sets, in steps of bounded size."""
    found = np.full((len(sets), count), np.iinfo(np.uint64).max, dtype=np.uint64)
    factors, shifts = FACTORS[:count], SHIFTS[:count]
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(values), 1024):
        part, owner = values[lo : lo + 1024], owners[lo : lo + 1024]
        hashed = part[:, None] * factors
        hashed += shifts
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(hashed, starts, axis=0)
        rows = owner[starts]
        found[rows] = np.minimum(found[rows], least)
    return found


def prefix_keys(minhashes: np.ndarray, trees: int, max_depth: int, depth: int) -> np.ndarray:
    """One number for each tree: its index and the label's prefix."""
    labels = minhashes.reshape(len(minhashes), trees, max_depth)[:, :, :depth]
    keys = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), labels.shape[:2]).copy()
    for level in range(depth):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, level])
    return keys.view(np.int64)


def similar(sets: list[np.ndarray], first: int, threshold: float) -> np.ndarray:
    """Which pairs are similar: all pairs if ``first`` is 0, else the first so many with the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    shared = np.bincount(column)[column] > 1
    owners, column = owners[shared], column[shared]
    common = np.zeros((n, n), dtype=np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
        for lo in range(0, int(column[-1]) + 1, SLAB):
            a, b = np.searchsorted(column, (lo, lo + SLAB))
            matrix = np.zeros((n, SLAB), dtype=np.float32)
            matrix[owners[a:b], column[a:b] - lo] = 1
            common += matrix @ matrix.T
    union = sizes[:, None] + sizes[None, :] - common
    found = common + 1e-9 * union >= threshold * union
    np.fill_diagonal(found, False)
    if first:
        found[:first, :first] = False
        found[first:, first:] = False
    return found


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row hangs together with."""
    roots = np.arange(len(linked))
    while True:
        reach = np.where(linked, roots[None, :], len(linked)).min(axis=1)
        following = np.minimum(roots, reach)
        following = following[following]
        if (following == roots).all():
            return roots
        roots = following


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def signed_rows(documents: DataFrame, *, key: str, text: str, shingle_words: int, trees: int, max_depth: int, depth: int) -> DataFrame:
    """One row per document: id, t1 and t2 (which text it has), node (which set; null without
    words) and a key for each tree."""
    source = documents.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), *_text_keys(F.col(f"`{text}`"))
    )
    schema = f"id {source.schema['id'].dataType.simpleString()}, t1 long, t2 long, node binary, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingle_set(hashes.of((t or "").lower().split()), shingle_words) for t in part.column(1).to_pylist()]
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    rows = prefix_keys(signatures(full, trees * max_depth), trees, max_depth, depth)
                    for at, row in zip([i for i, s in enumerate(sets) if len(s)], rows, strict=True):
                        keys[at] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "t1", "t2", "node", "keys"],
                )
        give_back()

    return long_texts(source).mapInArrow(run, schema)


def _verified(members: DataFrame, shingle_words: int, threshold: float) -> DataFrame:
    """Links of the nodes of each group: rows (node, links, root).

    ``members`` has the text of one document of each node, its group and the group's size.
    """
    schema = "grp binary, node binary, copies long, blocks int, shingles binary"
    columns = members.select("grp", "node", "copies", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingle_set(hashes.of(t.lower().split()), shingle_words).tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:4] + [pa.array(sets, pa.binary())], names=["grp", "node", "copies", "blocks", "shingles"]
                )
        give_back()

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = columns.mapInArrow(cut, schema).withColumn("own", own).withColumn("other", other)
    work = work.select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "shingles"
    ).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "own", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def done(rows: dict, key: tuple) -> None:
            nodes = list(rows)
            if len(nodes) < 2:
                return
            sets = [np.frombuffer(rows[n][2], dtype=np.uint64) for n in nodes]
            owns = [rows[n][0] for n in nodes]
            first = sum(o == key[1] for o in owns) if key[1] != key[2] else 0
            if key[1] != key[2] and first in (0, len(nodes)):
                return
            linked = similar(sets, first, threshold)
            copies = np.array([rows[n][1] for n in nodes])
            links, roots = linked @ copies, local_roots(linked)
            out.extend((nodes[i], int(links[i]), nodes[roots[i]]) for i in np.flatnonzero(links))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)],
                names=["node", "links", "root"],
            )

        current, rows = None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                columns = [c.to_pylist() for c in batch.slice(lo, 64).columns]
                for grp, i, j, own, node, copies, shingles in zip(*columns, strict=True):
                    if (grp, i, j) != current:
                        if current:
                            done(rows, current)
                        current, rows = (grp, i, j), {}
                    rows[node] = (own, copies, shingles)
            yield flush()
        if current:
            done(rows, current)
        yield flush()
        rows.clear()
        give_back()

    return work.mapInArrow(compare, "node binary, links long, root binary")


def near_classes(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per document: ``key``, t1, t2, class_id, n_class and n_links.

    Words are the text in lower case cut at white space. Two documents are linked if the
    Jaccard similarity of their shingle sets is at least ``threshold``; ``n_links`` counts a
    document's links, copies included. A class is what links hold together, ``class_id`` its
    smallest key and ``n_class`` its number of documents. t1 and t2 name the text.

    A text of fewer words than a shingle is one shingle. Null texts and those without words
    are linked to none, not even to each other; each is a class with its own key. Repeated
    rows are copies. Documents with a null key take part; a class of such has a null id. An
    empty table gives no rows. Other columns are not read.
    """
    depth = match_depth(threshold, trees, max_depth, target_recall)
    signed = written(
        signed_rows(documents, key=key, text=text, shingle_words=shingle_words, trees=trees, max_depth=max_depth, depth=depth),
        "near-signed",
    )
    nodes = written(
        signed.filter("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("id").alias("least_id"),
            F.min(F.struct("id", "t1", "t2")).alias("pick"), F.first("keys").alias("keys"),
        ),
        "near-nodes",
    )
    in_trees = nodes.select("node", F.explode("keys").alias("k"))
    shared = in_trees.groupBy("k").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1")
    stars = in_trees.join(shared.select("k", "center"), "k").filter("node <> center")
    groups = components(stars.select(F.col("node").alias("a"), F.col("center").alias("b")), "near-groups")
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    picked = (
        groups.join(sizes, "label").join(nodes.select("node", "copies", "pick"), "node")
        .select(F.col("label").alias("grp"), "n", "node", "copies", F.col("pick.id").alias("id"), F.col("pick.t1").alias("t1"), F.col("pick.t2").alias("t2"))
    )
    texts = documents.select(F.col(f"`{key}`").alias("of"), F.col(f"`{text}`").cast("string").alias("text"), *_text_keys(F.col(f"`{text}`")))
    members = texts.join(picked.hint("merge"), (F.col("of").eqNullSafe(F.col("id"))) & (texts["t1"] == picked["t1"]) & (texts["t2"] == picked["t2"]))
    links = written(_verified(members, shingle_words, threshold), "near-links")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(per_node, "node", "left").join(classes, "node", "left").filter("links IS NOT NULL OR copies > 1").select(
        "node", "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")
    )
    known = written(known, "near-known")
    heads = known.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("n_class"))
    known = known.join(heads, "label").select("node", "copies", "links", "class_id", "n_class")
    rows = signed.select("id", "t1", "t2", "node").join(known, "node", "left")
    return rows.select(
        F.col("id").alias(key), "t1", "t2",
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of one document of each class: the one with the smallest key.

    Of rows that repeat that key with an equal text one stays; a class without keys keeps one
    row for each of its different texts. Documents without words all stay.
    """
    found = near_classes(documents, key=key, text=text, **options).filter("n_class > 1")
    found = found.groupBy(F.col(key).alias("of"), F.col("t1").alias("f1"), F.col("t2").alias("f2")).agg(
        F.min("class_id").alias("class_id"), F.count("*").alias("rows")
    )
    found = written(found, "near-found")
    heads = found.filter("of = class_id").groupBy("class_id").agg(F.min(F.struct("f1", "f2")).alias("head"))
    marked = found.join(heads, "class_id", "left")
    stays = F.coalesce((F.col("of") == F.col("class_id")) & (F.struct("f1", "f2") == F.col("head")), F.col("class_id").isNull())
    marked = written(marked.select("of", "f1", "f2", "rows", stays.alias("stays")), "near-marked")
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{key}`").alias("id"), *_text_keys(F.col(f"`{text}`"))
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2"))
    # One plan for every size: the texts are shuffled once, by keys that no two documents share.
    left = rows.join(marked.filter("NOT stays OR rows > 1").hint("merge"), same, "left_anti").select("row")
    # Copies of one row meet in a partial aggregate, so a row repeated very often is no load.
    repeated = rows.join(marked.filter("stays AND rows > 1"), same, "left_semi").groupBy("id", "t1", "t2").agg(F.first("row").alias("row"))
    return left.union(repeated.select("row")).select("row.*")


def op4_ngram_jaccard_join(spark, sf_dir):
    """Every document with its class of near duplicates and its number of links."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "n_class", "n_links"
    )


# All pairs that share a shingle, and whatever can be reached over similar ones.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
p AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, p.b FROM reach JOIN p ON p.a = reach.q),
k AS (SELECT reach.r, min(d.doc_id) AS class_id, count(*) AS n_class FROM reach JOIN d ON d.r = reach.q GROUP BY reach.r),
l AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT doc_id, class_id, n_class, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN k USING (r) LEFT JOIN l USING (r)
"""
