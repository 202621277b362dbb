"""Substring dedup: documents factored against an index of reference blocks of the whole corpus.

Reference blocks are laid around anchors. Of the k-grams in each window of n words the smallest
is its anchor, so equal windows have the same anchor at the same place, and about one word in
fifteen is an anchor. Anchors and a hash of the block around each (all windows that can hold
it) are the index, counted over all documents.

Factors of a document come from its anchors. One that occurs once ends any factor. One whose
blocks are all equal is inside a longer factor: the whole block repeats. Where the blocks differ
a factor has its boundary nearby, and the windows of that anchor are counted one by one. A factor
is thus the longest stretch whose windows all repeat, whichever reference each repeats; greedy
pointers to one reference at a time would miss windows that lie across two factors.

Texts are joined twice with the marks on them; what is counted are hashes, summed in each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shingles import WordHashes, mixed, runs
from wayloom.llm.tables import long_texts, table, written

WINDOW, GRAM = 35, 8
BATCH_WORDS = 100_000
_CHUNK = 1 << 23
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RESULT_NAMES = ("n_words", "n_removed", "kept_text", "spans")


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, the rightmost of equal ones.

    Values are compared by their upper 40 bits; the lower ones hold the place meanwhile.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    found = []
    mask = np.uint64((1 << 24) - 1)
    for lo in range(0, count, _CHUNK):
        part = values[lo : lo + min(_CHUNK, count - lo) + width - 1]
        least = (part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
        span = 1
        while span < width:
            ahead = min(span, width - span)
            least = np.minimum(least[:-ahead], least[ahead:])
            span += ahead
        found.append((mask - (least & mask)).astype(np.int64) + lo)
    return np.concatenate(found)


class Words:
    """The words of several documents in a row, and hashes of any stretch of them."""

    def __init__(self, hashes: WordHashes, documents: list[list[bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        x = np.concatenate([hashes.of(d) for d in documents]) if documents else np.zeros(0, dtype=np.uint64)
        powers = np.full(len(x), _BASE, dtype=np.uint64)
        powers[:1] = 1
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * np.cumprod(powers), out=self.sums[1:])
        inverse = np.full(len(x) + 1, _INVERSE, dtype=np.uint64)
        inverse[:1] = 1
        self.inverse = np.cumprod(inverse)
        self.grams = runs(x, gram)
        owners = np.repeat(np.arange(len(documents)), lengths)
        starts = np.arange(max(0, len(x) - window + 1))
        self.starts = starts[starts + window <= self.ends[owners[: len(starts)]]]
        self.anchors = rightmost_least(self.grams, window - gram + 1)[self.starts]
        self.owners = owners

    def hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.inverse[first])

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Document, place in it, gram and block of each anchor."""
        places = np.unique(self.anchors)
        owner = self.owners[places]
        first = np.maximum(self.begins[owner], places + self.gram - self.window)
        last = np.minimum(self.ends[owner], places + self.window)
        clipped = ((places - first) * 256 + (last - places)).astype(np.uint64)
        block = mixed(self.hash(first, last) + clipped * _BASE)
        return owner, places - self.begins[owner], self.grams[places].view(np.int64), block.view(np.int64)

    def windows(self, wanted: list[list[int]]) -> tuple[np.ndarray, ...]:
        """Document, start in it, gram and hash of the windows of the wanted anchors."""
        marked = np.zeros(len(self.owners) + 1, dtype=bool)
        for begin, places in zip(self.begins, wanted, strict=True):
            marked[begin + np.asarray(places, dtype=np.int64)] = True
        at = np.flatnonzero(marked[self.anchors])
        starts, anchors = self.starts[at], self.anchors[at]
        owner = self.owners[starts]
        found = self.hash(starts, starts + self.window)
        return owner, starts - self.begins[owner], self.grams[anchors].view(np.int64), found.view(np.int64)


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of the rows) of parts with a bounded number of words, or one long text."""
    start, part, size = 0, [], 0
    for at, text in enumerate(texts):
        words = split_words(text.as_py())
        if part and size + len(words) > BATCH_WORDS:
            yield start, part
            start, part, size = at, [], 0
        part.append(words)
        size += len(words)
    if part:
        yield start, part


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    """t1 and t2 of the rows; their texts stay where they are."""
    return [batch.column(at).take(pa.array(rows, pa.int64())) for at in (1, 2)]


def _anchored(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per document with windows: a row number, the text's key, its anchors and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, documents in _batches(batch.column(0)):
                owner, place, grams, blocks = Words(hashes, documents, window, gram).blocks()
                counts = np.bincount(owner, minlength=len(documents))
                rows = np.flatnonzero(counts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts[rows])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows + number, pa.int64()), *_keys(batch, rows + start)]
                    + [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (place, grams, blocks)],
                    names=["row", "t1", "t2", "places", "grams", "blocks"],
                )
                number += len(documents)

    return long_texts(texts).select("text", "t1", "t2").mapInArrow(
        run, "row long, t1 long, t2 long, places array<long>, grams array<long>, blocks array<long>"
    )


def _counted_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows of the anchors named in ``mixed``: t1, t2, start, gram and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for start, documents in _batches(batch.column(0)):
                words = Words(hashes, documents, window, gram)
                owner, at, grams, found = words.windows(wanted[start : start + len(documents)])
                yield pa.RecordBatch.from_arrays(
                    [*_keys(batch, owner + start), pa.array(at, pa.int64()), pa.array(grams, pa.int64()), pa.array(found, pa.int64())],
                    names=["t1", "t2", "start", "gram", "hash"],
                )

    return texts.select("text", "t1", "t2", "mixed").mapInArrow(run, "t1 long, t2 long, start long, gram long, hash long")


def repeated_places(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """For each text (t1, t2) with repeated windows: places whose whole block repeats, and starts
    of repeated windows elsewhere. ``texts`` has text, t1 and t2."""
    anchored = written(_anchored(texts, window, gram), "dedup-anchors")
    index = (
        anchored.select(F.explode(F.arrays_zip("grams", "blocks")).alias("x")).select("x.grams", "x.blocks")
        .groupBy("grams").agg(F.count("*").alias("n"), F.min("blocks").alias("least"), F.max("blocks").alias("most"))
        .filter("n > 1").select("grams", (F.col("least") != F.col("most")).alias("differ"))
    )
    places = anchored.select("row", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("row", "x.places", "x.grams")
    marks = places.join(index, "grams").groupBy("row").agg(
        F.collect_list(F.when(~F.col("differ"), F.col("places"))).alias("whole"),
        F.collect_list(F.when(F.col("differ"), F.col("places"))).alias("mixed"),
    )
    # Equal texts have equal marks; one of them stands for all.
    marks = written(
        marks.join(anchored.select("row", "t1", "t2"), "row").groupBy("t1", "t2").agg(
            F.max(F.struct("row", "whole", "mixed")).alias("m")
        ).select("t1", "t2", "m.whole", "m.mixed"),
        "dedup-marks",
    )
    open_texts = texts.join(marks.filter("size(mixed) > 0").select("t1", "t2", "mixed"), ["t1", "t2"])
    windows = written(_counted_windows(open_texts, window, gram), "dedup-windows")
    repeated = windows.groupBy("gram", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "hash")
    starts = windows.join(repeated, ["gram", "hash"]).groupBy("t1", "t2").agg(F.collect_set("start").alias("starts"))
    return written(
        marks.select("t1", "t2", "whole").join(starts, ["t1", "t2"], "left").filter("size(whole) > 0 OR starts IS NOT NULL"),
        "dedup-places",
    )


def covered(n: int, whole: list[int], starts: list[int], window: int, gram: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.asarray(whole, dtype=np.int64)
    np.add.at(steps, np.maximum(0, at + gram - window), 1)
    np.add.at(steps, np.minimum(n, at + window), -1)
    at = np.asarray(starts, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    documents: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``keep``, n_words, n_removed, kept_text and spans (start and n_words of each factor removed).

    Words are cut at ASCII white space. A word goes if a window of ``window`` words over it has
    the same words as a window that starts anywhere else, in the same document or another; no
    occurrence is spared. The words that stay are joined by one space.

    Null and empty texts have no words; shorter ones than a window lose none; repeated rows
    repeat all their windows. Columns of ``keep`` named like a result give way. An empty table
    gives no rows.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is at most as long as a window")
    names = [c for c in keep if c not in RESULT_NAMES]
    source = documents.select(
        F.col(f"`{text}`").cast("string").alias("text"), *_text_keys(F.col(f"`{text}`")),
        F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in names]).alias("row"),
    )
    found = repeated_places(source.select("text", "t1", "t2"), window, gram)
    joined = source.join(found, ["t1", "t2"], "left").select("text", "whole", "starts", "row")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string, spans array<struct<start: long, n_words: long>>"
    span = pa.struct([("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sizes, gone, kept, spans = [], [], [], []
                for body, whole, starts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = split_words(body)
                    cuts: list[dict] = []
                    if whole or starts:
                        inside = covered(len(words), whole or [], starts or [], window, gram)
                        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)).tolist()
                        cuts = [{"start": a, "n_words": b - a} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        left = [words[i] for i in np.flatnonzero(~inside)]
                    else:
                        left = words
                    sizes.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                    spans.append(cuts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))],
                    names=["row", "n_words", "n_removed", "kept_text", "spans"],
                )

    return long_texts(joined).mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in names], *RESULT_NAMES)


def op9_substring_dedup(spark, sf_dir):
    """All documents without the passages of 35 words or more that occur elsewhere."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


# Every window of the corpus as a list slice, counted.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM win SEMI JOIN rep USING (h)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
