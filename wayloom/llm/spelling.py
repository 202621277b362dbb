"""Spelling variant grouping: a relational trie frontier finds all words one edit apart.

The trie is a distributed table of edges (depth, node, letter, child). States (word, position,
node, edits) start at the middle of their word and are joined with the edges of one depth after
the other: the same letter leads on, another letter or a left-out one costs the edit. A state
that has made its edit and meets the end of another word is a pair of neighbours.

One half of the word has no edit, so there are two tries, of the words and of the words
reversed, and edits are made in the second half only, where few words share a node. A pair is
found from its longer word, or from the one with the smaller letter. Edges carry a 64-bit mask of the
lengths and last letters below them, which ends most hopeless states before they are shuffled.
Nodes are named by a 64-bit hash; pairs are checked, so an equal hash can't make a wrong one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import long_texts, table, written
from wayloom.session import fresh_dir

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
FORM_FACTOR = 10
TYPO_EVERY = 31
MAX_WALKED = 64  # longer words are looked up by what is left without one letter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The bit of a word in the masks: its length and its last two letters in reading direction.
_BIT = "shiftleft(1L, CAST(pmod(xxhash64({length}, right({word}, 2)), 64) AS INT))"
_NODE = "xxhash64(reversed, substring(v, 1, {depth}))"
_START = "CAST((length(v) + int(reversed)) DIV 2 AS INT)"


def word_counts(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None,
) -> DataFrame:
    """word, n: the words of at least so many letters that occur at least so often.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With
    ``typo_every`` the letter at crc32 % length of every run whose crc32 of ``key:run`` that
    number divides is left out first; runs of rows without a key stay as they are. Null and
    empty texts have no words, repeated rows count again, other columns are not read.
    """
    runs = documents.select(
        F.col(f"`{key}`").cast("string").alias("key"),
        F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), 0)).alias("run"),
    )
    word = F.col("run")
    if typo_every:
        runs = runs.select("run", F.expr("crc32(CAST(concat(key, ':', run) AS BINARY))").alias("h"))
        at = F.expr("CAST(h % length(run) AS INT)")
        left_out = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % typo_every == 0, left_out).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
    )


def _both_ways(words: DataFrame) -> DataFrame:
    """reversed, v, n: each word as it is and from its end."""
    return words.select(
        F.inline(F.array(
            F.struct(F.lit(False).alias("reversed"), F.col("word").alias("v")),
            F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("v")),
        )),
        "n",
    )


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node, letter, child, target, target_n, below, mask: the second halves of the tries.

    An edge with an empty letter ends a word, its ``target``; ``below`` is the number of words
    that an edge leads to.
    """
    steps = _both_ways(words).withColumn("depth", F.explode(F.expr(f"sequence({_START}, length(v))")))
    ends = F.expr("depth = length(v)")
    return (
        steps.select(
            "depth", F.expr(_NODE.format(depth="depth")).alias("node"), F.expr("substring(v, depth + 1, 1)").alias("letter"),
            F.when(~ends, F.expr(_NODE.format(depth="depth + 1"))).alias("child"),
            F.when(ends, F.col("v")).alias("target"), F.when(ends, F.col("n")).alias("target_n"),
            F.expr(_BIT.format(length="length(v)", word="v")).alias("bit"),
        )
        .groupBy("depth", "node", "letter", "child", "target", "target_n")
        .agg(F.count(F.lit(1)).alias("below"), F.bit_or("bit").alias("mask"))
    )


def _moves(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of all states along the edges of their depth: the states they become.

    The state's ``own`` letter leads on. With an edit to spare, a greater letter takes its
    place, or the ``next`` one if ``own`` is left out, which is the last of several equal ones.
    """
    # What a move leads to must have the length and, with two letters to come, the last two.
    below = "(length(v) - position < 3 OR (mask & {bit}) <> 0)"
    same = below.format(bit=_BIT.format(length="length(v)", word="v"))
    less = below.format(bit=_BIT.format(length="length(v) - 1", word="v"))
    moves = (
        (f"edits = 1 AND letter = own AND if(position = depth, {same}, {less})", "position + 1", 1),
        ("edits = 0 AND letter = own AND below > 1", "position + 1", 0),
        (f"edits = 0 AND letter > own AND {same}", "position + 1", 1),
        (f"edits = 0 AND letter = next AND next <> own AND {less}", "position + 2", 1),
    )
    made = ", ".join(f"if({when}, named_struct('position', {at}, 'edits', {edits}), NULL)" for when, at, edits in moves)
    letters = states.selectExpr("*", "substring(v, position + 1, 1) AS own", "substring(v, position + 2, 1) AS next")
    return (
        letters.join(edges, "node").filter("letter = own OR (edits = 0 AND (letter > own OR letter = next))")
        .selectExpr("reversed", "v", "n", "child AS node", "target", "target_n", f"inline(filter(array({made}), m -> m IS NOT NULL))")
    )


def _walked_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: the pairs that the walk finds, some of them twice."""
    spark = words.sparkSession
    edges = trie_edges(words)
    trie = _partitioned(edges)
    starts = _both_ways(words).withColumn("depth", F.expr(_START))
    pending = {row.depth for row in starts.select("depth").distinct().collect()}  # at most MAX_WALKED
    levels, states, depth = fresh_dir(spark, "spelling-levels"), None, 0
    schema = "reversed BOOLEAN, v STRING, n BIGINT, node BIGINT, target STRING, target_n BIGINT, position INT, edits INT"
    spark.createDataFrame([], schema).write.parquet(f"{levels}/depth=0")
    while pending or states is not None:
        depth = min(pending) if states is None else depth + 1
        frontier = states
        if depth in pending:
            pending.remove(depth)
            fresh = starts.filter(F.col("depth") == depth).selectExpr(
                "reversed", "v", "n", _NODE.format(depth="depth") + " AS node", "depth AS position", "0 AS edits"
            )
            frontier = fresh if states is None else states.unionByName(fresh)
        at_depth = spark.read.schema(edges.schema).parquet(trie).filter(F.col("depth") == depth)
        _moves(frontier, at_depth).write.parquet(f"{levels}/depth={depth}")
        states = spark.read.schema(schema).parquet(f"{levels}/depth={depth}").filter("target IS NULL").drop("target", "target_n")
        if states.isEmpty():
            states = None
    found = spark.read.schema(schema).parquet(levels).filter("target IS NOT NULL")
    return found.select(
        F.when(F.col("reversed"), F.reverse("v")).otherwise(F.col("v")).alias("a"), F.col("n").alias("a_n"),
        F.when(F.col("reversed"), F.reverse("target")).otherwise(F.col("target")).alias("b"), F.col("target_n").alias("b_n"),
    )


def _partitioned(edges: DataFrame) -> str:
    """The edges in a folder per depth, of which each step reads its own."""
    path = fresh_dir(edges.sparkSession, "spelling-edges")
    edges.write.partitionBy("depth").parquet(path)
    return path


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def gap_keys(word: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a word without each letter, of it with a gap there, and of the whole word."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(29)
    powers = np.full(len(codes), _BASE, dtype=np.uint64)
    powers[0] = 1
    terms = codes * np.cumprod(powers)
    before = np.cumsum(terms) - terms
    whole = terms.sum()
    after = whole - before - terms
    return before + after * np.uint64(_INVERSE), whole - terms, int(whole)


def _long_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of words too long to walk, by equal hashes without one letter.

    A word has two short rows per letter; words that meet in one of them differ in that one
    letter, so no group is large.
    """
    numbered = written(words.withColumn("id", F.monotonically_increasing_id()), "spelling-long")
    schema = "id long, kind string, length int, place int, h long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                without, gaps, whole = gap_keys(word)
                parts = [("whole", len(word), np.array([whole], dtype=np.uint64))]
                if len(word) > MAX_WALKED:
                    parts += [("less", len(word) - 1, without), ("gap", len(word), gaps)]
                for kind, length, hashes in parts:
                    for lo in range(0, len(hashes), 1 << 16):
                        part = hashes[lo : lo + (1 << 16)].view(np.int64)
                        place = np.arange(lo, lo + len(part), dtype=np.int32) if kind == "gap" else np.zeros(len(part), dtype=np.int32)
                        yield pa.RecordBatch.from_pydict({
                            "id": pa.array(np.full(len(part), at)), "kind": [kind] * len(part),
                            "length": pa.array(np.full(len(part), length, dtype=np.int32)), "place": place, "h": part,
                        })

    rows = written(long_texts(numbered.select("word", "id")).mapInArrow(keys, schema).distinct(), "spelling-gaps")
    one, other = rows.withColumnRenamed("id", "i"), rows.withColumnRenamed("id", "j")
    met = (
        one.filter("kind = 'less'").join(other.filter("kind = 'whole'"), ["length", "h"]).select("i", "j")
        .union(one.filter("kind = 'gap'").join(other.filter("kind = 'gap'"), ["length", "place", "h"]).filter("i < j").select("i", "j"))
        .distinct()
    )
    a = numbered.select(F.col("id").alias("i"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = numbered.select(F.col("id").alias("j"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    return met.join(a, "i").join(b, "j").select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two words one inserted, deleted or replaced letter apart,
    from both sides, once each. ``words`` has distinct words and their n."""
    pairs = _walked_pairs(words.filter(F.length("word") <= MAX_WALKED))
    long = words.filter(F.length("word") >= MAX_WALKED)
    if not long.isEmpty():
        pairs = pairs.unionAll(_long_pairs(long))
    pairs = pairs.filter(F.levenshtein("a", "b", 1) == 1)
    sides = [F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    # Distinct within the partitions by word, which the next aggregate by word uses again.
    return pairs.select(F.inline(F.array(*sides))).repartition("word").distinct()


def spelling_variants(words: DataFrame, *, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n).

    ``form`` is the most frequent near word (of equal ones the smallest) if it is at least
    ``factor`` times as frequent, ``root`` what forms lead to in the end, the word itself if
    it has none. Words are distinct and not null; no words give no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= factor * F.col("n")
    near = written(
        near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")),
        "spelling-near",
    )
    roots = _roots(near.filter("form IS NOT NULL").select("word", "form"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root by pointer doubling. Counts grow tenfold from form to form, so a chain is short."""
    reached = forms.withColumnRenamed("form", "root")
    while True:
        further = written(
            reached.join(reached.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", "root", "next"),
            "spelling-roots",
        )
        reached = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.filter("next IS NOT NULL").isEmpty():
            return reached


def op11_spelling_variants(spark, sf_dir):
    """Every word of the documents with its most frequent neighbour, if that is far more frequent."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(written(word_counts(documents, typo_every=TYPO_EVERY), "spelling-words"))


# The checksum goes over the hex digits of the bytes, the lower half of a byte first, with the
# 16 remainders of the CRC-32 polynomial. Near words meet in a word with a gap or one letter less.
ORACLE = rf"""
WITH RECURSIVE step AS (SELECT i, CASE WHEN i % 2 = 1 THEN xor(3988292384, i // 2) ELSE i // 2 END::BIGINT AS c FROM range(16) t(i)),
step2 AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END AS c FROM step),
step3 AS (SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END AS c FROM step2),
step4 AS (SELECT list(CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END ORDER BY i) AS t FROM step3),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]{{{MIN_LENGTH},}}')) AS r FROM documents),
x AS (SELECT DISTINCT doc_id, r, hex(encode(doc_id || ':' || r)) AS x FROM r WHERE doc_id IS NOT NULL),
h AS (SELECT doc_id, r, xor(list_reduce(
    list_transform(range(length(x)), lambda i: instr('0123456789ABCDEF', x[i + 1 + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END])::BIGINT - 1),
    lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM x, step4),
c AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN r[:(h % length(r))::INT] || r[(h % length(r) + 2)::INT:] ELSE r END AS w FROM r LEFT JOIN h USING (doc_id, r)),
w AS (SELECT w, count(*) AS n FROM c GROUP BY w HAVING count(*) >= {MIN_COUNT} AND length(w) >= {MIN_LENGTH}),
g AS (SELECT w, n, unnest(range(length(w))) AS i FROM w),
k AS (SELECT w, n, i, w[:i] || '*' || w[i + 2:] AS k FROM g),
p AS (SELECT a.w AS a, b.w AS b FROM k a JOIN k b ON a.k = b.k AND a.w <> b.w
  UNION SELECT a.w, b.w FROM k a JOIN w b ON b.w = replace(a.k, '*', '')
  UNION SELECT b.w, a.w FROM k a JOIN w b ON b.w = replace(a.k, '*', '')),
f AS (SELECT a AS w, count(*) AS n_near, min(struct_pack(less := -w.n, near := b)) AS best FROM p JOIN w ON w.w = b GROUP BY a),
v AS (SELECT w, n, n_near, CASE WHEN -best.less >= {FORM_FACTOR} * n THEN best.near END AS form, CASE WHEN -best.less >= {FORM_FACTOR} * n THEN -best.less END AS form_n
  FROM w LEFT JOIN f USING (w)),
q AS (SELECT w, w AS root, form AS next FROM v UNION ALL SELECT q.w, v.w, v.form FROM q JOIN v ON v.w = q.next)
SELECT v.w AS word, form, q.root, n::BIGINT AS n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM v JOIN q ON q.w = v.w AND q.next IS NULL
"""
