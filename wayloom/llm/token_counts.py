"""Token counts: batches balanced by bytes are encoded in Arrow functions, lengths come back.

No piece of the vocabulary goes on after a letter into the next white-space mark, so a text may
be cut before any run of spaces that follows another character, and the counts of its chunks
add up to its own. Each different chunk of a batch is encoded once; batches are cut by the bytes
of their texts, and a text beyond that is cut at such a place, too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import give_back, long_texts, table

LIMIT = 4096
BATCH_BYTES = 8 << 20
MARK = "▁"  # fixed value: what the pieces hold in place of a space

# Texts in which spaces are not single ones between words, and the chunks of such texts.
_ODD = f"  |^ | $|{MARK}"
_CHUNKS = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.can_cut = self._can_cut()

    def _can_cut(self) -> bool:
        """True if chunks have the tokens that they have in their text."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        kept = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        marked = norm.add_dummy_prefix and norm.escape_whitespaces and not trained.treat_whitespace_as_suffix
        bpe = trained.model_type == trained.BPE and trained.byte_fallback
        own = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
        inside = any(p.type == own or MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        return kept and marked and bpe and not inside and MARK in {p.piece for p in proto.pieces}

    def _lengths(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.model.encode(names, num_threads=1)), dtype=np.int64, count=len(names))

    def _chunk_sums(self, chunks: pa.Array, ends: np.ndarray, empty: int) -> np.ndarray:
        """Sums of the chunks before each of ``ends``, of which each different one is encoded once."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        lengths = self._lengths(names)
        if "" in names:
            lengths[names.index("")] = empty
        sums = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(sums[np.concatenate([[0], ends])])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; there are no nulls."""
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        if not self.can_cut:
            return self._lengths(texts.to_pylist())
        found = np.zeros(len(texts), dtype=np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if len(split):
            found[~odd] = self._chunk_sums(split.flatten(), split.offsets.to_numpy()[1:] - split.offsets[0].as_py(), 0)
        if odd.any():
            # The model puts one mark before a text, which here takes the place of the chunk's first.
            chunks = [[chunk[1:] for chunk in _CHUNKS.findall(" " + text)] for text in texts.filter(pa.array(odd)).to_pylist()]
            flat = pa.array([chunk for part in chunks for chunk in part], pa.string())
            found[odd] = self._chunk_sums(flat, np.cumsum([len(part) for part in chunks]), 1)
        return found

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of some ``size`` characters whose counts add up, if it can be cut."""
        start, look = 0, size
        while self.can_cut and look < len(text) - 1:
            at = text.find(" ", look)
            if not 0 <= at < len(text) - 1:
                break
            if at > start and text[at - 1] not in (" ", MARK):
                yield text[start:at]
                start, look = at + 1, at + 1 + size
            else:
                look = at + 1
        yield text[start:]


class JsonCounter:
    """Counts under a tokenizers file; its texts are not cut."""

    can_cut = False

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: pa.Array) -> np.ndarray:
        found = self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return np.fromiter((len(item.ids) for item in found), dtype=np.int64, count=len(texts))

    def parts(self, text: str, size: int) -> Iterator[str]:
        yield text


def counter(path: str) -> PieceCounter | JsonCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def batch_counts(model: PieceCounter | JsonCounter, texts: pa.Array, batch_bytes: int) -> np.ndarray:
    """Tokens of each text, encoding some ``batch_bytes`` at a time. Null is the empty text."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros(len(texts), dtype=np.int64)
    batch = (np.cumsum(sizes) - sizes) // batch_bytes
    starts = np.flatnonzero(np.diff(batch, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
        # Only the last text of a batch can be much longer than the batch should be.
        if sizes[hi - 1] <= batch_bytes:
            found[lo:hi] = model.counts(texts.slice(lo, hi - lo))
        else:
            found[lo : hi - 1] = model.counts(texts.slice(lo, hi - 1 - lo))
            for part in model.parts(texts[int(hi - 1)].as_py(), batch_bytes // 2):
                found[hi - 1] += model.counts(pa.array([part], pa.string())).sum()
    return found


def token_counts(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    limit: int = LIMIT, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit, which says that there are more than ``limit``.

    The tokens are those of the library for the ``tokenizer`` file, sentencepiece for .model and
    tokenizers for others, without added special ones. Null and empty texts have none; repeated
    rows, equal and null keys are counted one by one; an empty table gives no rows. Other columns
    are not read. A key named like a result keeps its name, and that result is left out.
    """
    path = tokenizer or default_path()
    source = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(pc.fill_null(texts, "")).cast(pa.int64())
            found = pa.array(batch_counts(model, texts, batch_bytes))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, found], names=["key", "n_bytes", "n_tokens"])
        give_back()

    counted = long_texts(source).mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    results = {"n_bytes": F.col("n_bytes"), "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit}
    return counted.select(F.col("key").alias(key), *[column.alias(name) for name, column in results.items() if name != key])


def op13_token_counts(spark, sf_dir):
    """Bytes and tokens of every document, and whether it has over 4096 of them."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
