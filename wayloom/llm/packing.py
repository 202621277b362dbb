"""Packing: examples into sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing. Each example is a vector (tokens, 1 segment, loss-bearing tokens), each
open sequence the vector of what it can still take. The example that fits with the largest
dot product of the two, both relative to the limits, goes in next. When none fits whole, the
longest one is cut to fill the rest.

Every task packs its own partition as it reads it and holds a bounded number of tokens, so
nothing is shuffled, no task sees more than its share, and a lost task can be run again alone.
What is left at the end of a partition becomes sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import give_back, long_texts, table
from wayloom.llm.tokens import default_path, forget, of_process

END_ID = 2
FLUSH_IDS = 1 << 20
PIECES = (
    "start long, length long, loss long, doc_tokens long, sequence_id long, offset long, ids binary"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class Packer:
    """Examples waiting for a sequence; yields whole sequences as lists of pieces.

    A piece is (key, start, length). ``lead`` is the number of tokens at the start of an
    example that bear no loss.
    """

    def __init__(self, limits: Limits, buffer_tokens: int, buffer_examples: int = 4096):
        self.limits, self.buffer_tokens = limits, buffer_tokens
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.keys = np.zeros(buffer_examples, dtype=np.int64)
        self.starts, self.ends, self.leads = (np.zeros_like(self.keys) for _ in range(3))
        self.count, self.total = 0, 0

    def add(self, key: int, tokens: int, lead: int) -> Iterator[list]:
        start = 0
        while tokens - start >= self.limits.tokens and self._loss(start, start + self.limits.tokens, lead) <= self.limits.loss:
            yield [(key, start, self.limits.tokens)]
            start += self.limits.tokens
        if start < tokens:
            at = self.count
            self.keys[at], self.starts[at], self.ends[at], self.leads[at] = key, start, tokens, lead
            self.count += 1
            self.total += tokens - start
        if self.count == len(self.keys) or self.total >= self.buffer_tokens:
            yield from self.drain(self.buffer_tokens // 2, len(self.keys) // 2)

    def drain(self, tokens: int = 0, examples: int = 0) -> Iterator[list]:
        """Fills sequences until no more than so many tokens and examples wait."""
        while self.count and (self.total > tokens or self.count > examples):
            yield self._fill()

    @staticmethod
    def _loss(start: int, end: int, lead: int) -> int:
        return max(0, end - max(start, lead))

    def _take(self, at: int, length: int) -> tuple[int, int, int]:
        piece = (int(self.keys[at]), int(self.starts[at]), length)
        self.total -= length
        if self.starts[at] + length == self.ends[at]:
            self.count -= 1
            for column in (self.keys, self.starts, self.ends, self.leads):
                column[at] = column[self.count]
        else:
            self.starts[at] += length
        return piece

    def _fill(self) -> list:
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        sequence = []
        while self.count and room[0] and room[1]:
            starts, ends, leads = (c[: self.count] for c in (self.starts, self.ends, self.leads))
            tokens = ends - starts
            loss = np.maximum(0, ends - np.maximum(starts, leads))
            fits = (tokens <= room[0]) & (loss <= room[2])
            if fits.any():
                wanted = room * self.scale**2
                score = np.where(fits, tokens * wanted[0] + loss * wanted[2], -1.0)
                at = int(score.argmax())
                length = int(tokens[at])
            else:
                heads = np.minimum(np.minimum(tokens, room[0]), np.maximum(0, leads - starts) + room[2])
                at = int(np.where(heads > 0, tokens, -1).argmax())
                length = int(heads[at])
                if not length:
                    break
            spent = self._loss(int(starts[at]), int(starts[at]) + length, int(leads[at]))
            sequence.append(self._take(at, length))
            room -= np.array([length, 1, spent])
        return sequence


def power_of_two_parts(sequence: list, limit: int) -> list[list]:
    """The pieces of one sequence as sequences whose lengths are powers of two, or the limit."""
    left, parts, pieces = sum(p[2] for p in sequence), [], list(reversed(sequence))
    while left:
        room = limit if left >= limit else 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            key, start, length = pieces.pop()
            taken = min(length, room)
            part.append((key, start, taken))
            room -= taken
            if taken < length:
                pieces.append((key, start + taken, length - taken))
        parts.append(part)
    return parts


def pack(
    examples: DataFrame,
    *,
    keep: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),
    tokenizer: str | None = None,
    end_id: int = END_ID,
    buffer_tokens: int = 500_000,
    keep_words: bool = False,
) -> DataFrame:
    """One row per piece: ``keep``, its place in the example and in a sequence, and its ids.

    An example's tokens are those of ``prompt``, if that column is named, those of ``text``,
    and ``end_id``; those of the prompt bear no loss. ``ids`` holds little-endian unsigned
    32-bit ids. Null and empty texts have the end id alone; repeated rows and equal or null
    keys are examples of their own; an empty table gives no rows; other columns are not read.
    Sequences stay within all limits. Those that are not full because of their segments or
    loss need padding; the last of each partition are cut to powers of two.

    With ``keep_words`` a worker process remembers the pieces of words it has seen (700,000 and
    those of one step more) from task to task, which saves time where a job does nothing else.
    """
    path = tokenizer or default_path()
    columns = [F.col(f"`{keep}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")]
    columns.append((F.col(f"`{prompt}`").cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"))
    source = examples.select(*columns)
    key_type = source.schema["key"].dataType
    # The key travels as text or number of its own type; Arrow keeps it as it is.
    schema = f"key {key_type.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = of_process(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        packer = Packer(limits, buffer_tokens)
        held: dict[int, list] = {}  # example number -> [key, ids, tokens still to place]
        number, sequence_id = 0, TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size = 0  # ids in rows
        key_field = None

        def place(sequence: list) -> int:
            nonlocal sequence_id, size
            offset = 0
            for example, start, length in sequence:
                entry = held[example]
                key, ids, left, lead = entry
                rows.append((
                    key, start, length, max(0, start + length - max(start, lead)), len(ids) // 4,
                    sequence_id, offset, ids[4 * start : 4 * (start + length)],
                ))
                offset += length
                entry[2] = left - length
                if not entry[2]:
                    del held[example]
            sequence_id += 1
            size += offset
            return offset

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            types = [key_field.type, *[pa.int64()] * 6, pa.binary()]
            names = ["key", "start", "length", "loss", "doc_tokens", "sequence_id", "offset", "ids"]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names
            )
            rows.clear()
            size = 0
            return batch

        for batch in batches:
            key_field = batch.schema.field(0)
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys, texts, prompts = (part.column(i).to_pylist() for i in range(3))
                bodies = words.encode_all([body or "" for body in texts])
                heads = words.encode_all([head or "" for head in prompts])
                for key, first, body in zip(keys, heads, bodies, strict=True):
                    ids = first + body + end
                    held[number] = [key, ids, len(ids) // 4, len(first) // 4]
                    for sequence in packer.add(number, len(ids) // 4, len(first) // 4):
                        place(sequence)
                        if size >= FLUSH_IDS or len(rows) >= 4096:
                            yield flush()
                    number += 1
        waiting = list(packer.drain())
        for sequence in waiting[:-1]:
            place(sequence)
        for sequence in waiting[-1:]:
            for part in power_of_two_parts(sequence, limits.tokens):
                place(part)
        if rows:
            yield flush()
        if not keep_words:
            forget(path)
        give_back()

    return long_texts(source).mapInArrow(run, schema).withColumnRenamed("key", keep)


def op3_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens; each piece with the checksum of its ids."""
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_words=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
