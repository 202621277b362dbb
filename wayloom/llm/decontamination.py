"""Benchmark decontamination: suffix arrays of the corpus, searched for every test suffix.

The documents of a task are cut into shards. Each shard gets a suffix array of its words, cut
to the window length, and every window of the test items is found in it by binary search. A
suffix that starts with a word no test item holds can't match and is left out of the array.
Windows that follow each other in both texts make one match, the longest verbatim one there.

The test items go to every task, so their size is checked first; documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import long_texts, table

WINDOW = 13
MIN_SHARE = 0.05
MAX_BENCHMARK_BYTES = 256 << 20
SHARD_WORDS = 250_000
RESULT = (
    "n_words long, n_hit long, items array<string>, "
    "matches array<struct<item_id: string, doc_start: long, item_start: long, n_words: long>>"
)
RESULT_NAMES = ("n_words", "n_hit", "items", "matches", "contaminated")

# A-Z become a-z; every other ASCII character but digits and letters becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


class TestWindows:
    """The windows of all test items as fixed-width keys of word numbers."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.item_ids = [item_id for item_id, _ in items]
        first: dict[tuple[int, bytes], tuple[int, int]] = {}  # (item, key) -> (length, first start)
        for item, (_, text) in enumerate(items):
            words = [w for w in split_words(text or "") if w]
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=">u4")
            length = min(window, len(ids))
            for start in range(len(ids) - length + 1) if length else ():
                first.setdefault((item, ids[start : start + length].tobytes()), (length, start))
        grouped: dict[bytes, list[tuple[int, int]]] = {}
        for (item, key), (_, start) in first.items():
            grouped.setdefault(key, []).append((item, start))
        keys = sorted(grouped)
        self.lengths = np.array([len(key) // 4 for key in keys], dtype=np.int64)
        width = 4 * window
        self.low = np.array([key.ljust(width, b"\0") for key in keys], dtype=f"S{width}")
        self.high = np.array([key.ljust(width, b"\xff") for key in keys], dtype=f"S{width}")
        self.owners = [np.array(grouped[key], dtype=np.int64) for key in keys]
        self.least = int(self.lengths.min()) if keys else 0

    def word_numbers(self, text: str | None) -> np.ndarray:
        """0 for words of no test item."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        get = self.numbers.get
        return np.array([get(w, 0) for w in split_words(text) if w], dtype=np.uint32)


def suffix_array(ids: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (cut to the window) and their places; only those with ``least`` known words."""
    known = np.concatenate([ids > 0, np.zeros(window, dtype=bool)])
    sums = np.concatenate([[0], np.cumsum(known)])
    places = np.flatnonzero(sums[least : least + len(ids)] - sums[: len(ids)] == least)
    padded = np.concatenate([ids, np.zeros(window, dtype=np.uint32)]).astype(">u4")
    rows = np.lib.stride_tricks.sliding_window_view(padded, window)[places]
    keys = np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def search_shard(tests: TestWindows, documents: list[np.ndarray]) -> list[tuple[int, list, list]]:
    """(number of hit words, items, matches) of each document of a shard."""
    gap = np.zeros(1, dtype=np.uint32)
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    results: list[tuple[int, list, list]] = [(0, [], []) for _ in documents]
    if not tests.least:
        return results
    ids = np.concatenate([x for d in documents for x in (d, gap)])
    suffixes, places = suffix_array(ids, tests.window, tests.least)
    if not len(places):
        return results
    lo = np.searchsorted(suffixes, tests.low, "left")
    hi = np.searchsorted(suffixes, tests.high, "right")
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    found = []
    for at in np.flatnonzero(hi > lo):
        where = places[lo[at] : hi[at]]
        length = tests.lengths[at]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + length, -1)
        owners = tests.owners[at]
        block = np.empty((len(where) * len(owners), 4), dtype=np.int64)
        block[:, 0] = np.repeat(where, len(owners))
        block[:, 1] = np.tile(owners[:, 0], len(where))
        block[:, 2] = np.tile(owners[:, 1], len(where))
        block[:, 3] = length
        found.append(block)
    if not found:
        return results
    hits = np.cumsum(cover[:-1]) > 0
    rows = np.concatenate(found)
    diagonal = rows[:, 0] - rows[:, 2]
    rows, diagonal = (x[np.lexsort((rows[:, 0], diagonal, rows[:, 1]))] for x in (rows, diagonal))
    breaks = np.ones(len(rows), dtype=bool)
    breaks[1:] = (rows[1:, 1] != rows[:-1, 1]) | (diagonal[1:] != diagonal[:-1]) | (rows[1:, 0] != rows[:-1, 0] + 1)
    starts = np.flatnonzero(breaks)
    runs = np.diff(np.concatenate([starts, [len(rows)]]))
    owner = np.searchsorted(begins, rows[starts, 0], "right") - 1
    for document in np.unique(owner):
        matches = []
        items = set()
        for at in np.flatnonzero(owner == document):
            place, item, item_start, length = (int(x) for x in rows[starts[at]])
            item_id = tests.item_ids[item]
            matches.append((item_id, place - int(begins[document]), item_start, int(runs[at]) + length - 1))
            if item_id is not None:
                items.add(item_id)
        inside = hits[begins[document] : begins[document] + lengths[document]]
        matches.sort(key=lambda m: (m[1], m[0] is None, m[0] or "", m[2]))
        results[document] = (int(inside.sum()), sorted(items), matches)
    return results


def screen(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_share: float = MIN_SHARE,
    max_benchmark_bytes: int = MAX_BENCHMARK_BYTES,
) -> DataFrame:
    """One row per document: ``keep``, n_words, n_hit, items, matches and contaminated.

    A window is ``window`` words of an item, or all words of a shorter one. ``contaminated``:
    at least ``min_share`` of the words lie in occurrences of windows. A match names the item,
    where it starts in both texts, and its length in words; inside an item that repeats itself
    it is measured from the first place of the window.

    Null and empty texts have no words; items without words match nothing; items whose id is
    null hit words but aren't listed; repeated items count once for each id. Columns of
    ``keep`` named like a result give way to it. More than ``max_benchmark_bytes`` of items is
    an error: screen against parts of the benchmark one after the other.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + F.lit(100))).first()[0] or 0
    if size > max_benchmark_bytes:
        raise ValueError(f"{size} bytes of test items; the limit is {max_benchmark_bytes}")
    tests = spark.sparkContext.broadcast(TestWindows(sorted(map(tuple, items.collect()), key=repr), window))
    names = [c for c in keep if c not in RESULT_NAMES]
    source = documents.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in names])
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names] + [RESULT])
    match = pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tests.value
        for batch in batches:
            texts, start = batch.column(0), 0
            while start < batch.num_rows:
                shard, total, end = [], 0, start
                while end < batch.num_rows and total < SHARD_WORDS:
                    shard.append(known.word_numbers(texts[end].as_py()))
                    total += len(shard[-1])
                    end += 1
                found = search_shard(known, shard)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    part.columns[1:]
                    + [
                        pa.array([len(d) for d in shard], type=pa.int64()),
                        pa.array([f[0] for f in found], type=pa.int64()),
                        pa.array([f[1] for f in found], type=pa.list_(pa.string())),
                        pa.array(
                            [[dict(zip(("item_id", "doc_start", "item_start", "n_words"), m, strict=True)) for m in f[2]] for f in found],
                            type=pa.list_(match),
                        ),
                    ],
                    names=[*names, "n_words", "n_hit", "items", "matches"],
                )
                start = end

    judged = long_texts(source).mapInArrow(run, schema)
    return judged.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") + 1e-6 >= F.lit(min_share) * F.col("n_words"))
    )


def op6_benchmark_decontamination(spark, sf_dir):
    """Every document against every test item; a twentieth of its words contaminates it."""
    judged = screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


# The same windows, found by position in DuckDB: list slices of both word lists.
ORACLE = r"""
WITH i AS (
  SELECT item_id::VARCHAR AS item_id, w, least(13, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, w[s:s + k - 1] AS key
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
pos AS (
  SELECT r, k, p, w[p:p + k - 1] AS key
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT r, p, pos.k, item_id FROM pos JOIN win ON pos.key = win.key AND pos.k = win.k),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
