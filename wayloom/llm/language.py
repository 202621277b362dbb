"""Language ID by compression: the language whose dictionary makes a text smallest.

For each language a raw-content dictionary is gathered from labelled rows. A text is brought
to its words in lower case and cut into short chunks, so that every part of it meets the
dictionary and not only what came before in the text. Every chunk is compressed with each
dictionary, and the sizes are added up. The smallest total wins; where it is close, the
slowest level, which finds the shortest matches, decides. ``score`` says by how much the
smallest total won, and a narrow margin is a rejection.

The dictionaries have a fixed size, and the labelled rows behind them are a bounded sample:
at most ``rows_per_language`` different texts, chosen by a hash. Prediction reads whole texts and moves none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import long_texts, table

UNDETERMINED = "und"
MIN_SCORE = 0.005
CHUNK_BYTES = 1024
CLOSE = 0.03
SLOWEST_LEVEL = 19
WORDS = regex.compile(r"\p{L}+")
_BUCKETS = 1 << 30


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, and the compression level."""

    dictionaries: dict[str, bytes]
    level: int = 5


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = 800,
    dictionary_bytes: int = 112_640,
    max_languages: int = 500,
    level: int = 5,
) -> LanguageModel:
    """Dictionaries from rows whose text and language are not null.

    Equal texts count once. Each gives the dictionary a part that starts anywhere in it, by a
    hash, and has at most as many bytes as leave a place for all sampled texts of its language.
    No labelled rows: no language.
    More than ``max_languages`` values of ``lang`` is an error, as all dictionaries go to each task.
    """
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0")
    # Copies are drawn together, so texts are counted as they are drawn: by their hash.
    rows = rows.withColumn("h", F.xxhash64("text"))
    different = rows.select("lang", "h").distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in different.limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageModel({}, level)
    # Drawn with a margin of six deviations, and cut to the number wanted.
    drawn = rows_per_language + 6 * math.isqrt(rows_per_language) + 6
    share, part = F.lit(0), F.lit(0)
    for name, count in counts.items():
        kept = min(_BUCKETS, _BUCKETS * drawn // count + 1)
        share = F.when(F.col("lang") == name, kept).otherwise(share)
        # Twice the place, as only letters are kept.
        part = F.when(F.col("lang") == name, max(1, 2 * dictionary_bytes // min(count, rows_per_language))).otherwise(part)
    start = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - F.col("part") + 1, F.lit(1))).cast("int")
    sample = (
        rows.filter(F.pmod("h", F.lit(_BUCKETS)) < share)
        .withColumn("part", part)
        .select("lang", "h", F.substring("text", start, F.col("part")).alias("text"))
        .groupBy("lang", "h").agg(F.min("text").alias("text"))
        .collect()
    )
    content: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["h"] % _BUCKETS, r["h"])):
        texts = content.setdefault(row["lang"], [])
        if len(texts) < rows_per_language:
            texts.append(letters(row["text"]))
    return LanguageModel({name: _dictionary(texts, dictionary_bytes) for name, texts in sorted(content.items())}, level)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A part of each text; what short ones leave free goes to longer ones."""
    parts, left = [t.encode("utf-8", "surrogatepass") for t in texts], size
    for n, at in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i]))):
        room = max(0, left // (len(parts) - n) - 1)
        if len(parts[at]) > room:
            parts[at] = parts[at][:room].decode("utf-8", "ignore").encode()
        left -= len(parts[at]) + 1
    return b" ".join(parts)[:size]


def letters(text: str) -> str:
    return " ".join(WORDS.findall(text.lower()))


class Classifier:
    """Compressors of one task."""

    def __init__(self, model: LanguageModel):
        self.model, self.languages = model, list(model.dictionaries)
        self.compressors: dict[int, list] = {}

    def _sizes(self, chunks: list[bytes], level: int) -> list[int]:
        if level not in self.compressors:
            import zstandard

            made = self.compressors[level] = []
            for content in self.model.dictionaries.values():
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(
                    level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False
                ).compress)
        return [sum(map(len, map(compress, chunks))) for compress in self.compressors[level]]

    def classify(self, text: str | None) -> tuple[str, float]:
        data = letters(text or "").encode("utf-8", "surrogatepass")
        if not data or not self.languages:
            return UNDETERMINED, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        chunks = [data[start : start + CHUNK_BYTES] for start in range(0, len(data), CHUNK_BYTES)]
        best, second, at = self._ranked(self._sizes(chunks, self.model.level))
        if second - best < CLOSE * second:
            best, second, at = self._ranked(self._sizes(chunks, SLOWEST_LEVEL))
        return self.languages[at], (second - best) / second

    @staticmethod
    def _ranked(sizes: list[int]) -> tuple[int, int, int]:
        best, second = sorted(sizes)[:2]
        return best, second, sizes.index(best)


def identify(
    documents: DataFrame, model: LanguageModel, *, text: str = "text", min_score: float = 0.0
) -> DataFrame:
    """All columns of the documents, and lang_pred, score, rejected.

    ``lang_pred`` is ``und`` for a null text, one without letters, and when nothing was
    learned. ``score`` is the part by which the best size is below the second best, 0 to 1;
    1 if one language was learned. Equal sizes go to the language first in order.
    ``rejected``: ``und``, or a score below ``min_score``. Columns of these names give way.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most max_languages dictionaries
    names = [c for c in documents.columns if c not in ("lang_pred", "score", "rejected")]
    at = names.index(text)
    source = documents.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            found = [classifier.classify(value.as_py()) for value in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                batch.columns
                + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    predicted = long_texts(source).mapInArrow(run, f"{schema}, lang_pred string, score double")
    return predicted.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_score))


def op7_language_id(spark, sf_dir):
    """Every document by dictionaries of the documents that aren't held out."""
    documents = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    )
    model = fit(documents.filter("doc_id IS NOT NULL AND NOT held_out"))
    return identify(documents.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
