"""Token ids of texts under the word tokenizer, with a bounded memory of pieces already seen."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 21
ENCODED_CHARS = 1 << 16
MAX_CHUNKS = 250_000  # so many different chunks are cut at a time
MAX_PIECES = 700_000

# The characters for which lower case is the same in every Unicode version, and
# what they and their lower case are.
PLAIN = r"^[!-~¡-ĩĲ-ňŊ-ɏ]*$"
LETTER, NUMBER, OTHER = range(3)
KINDS = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x2B0)], dtype=np.int8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_slices(text: str) -> Iterator[str]:
    """Parts of some million characters, cut at a space; a part ends later if there is none."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        end = text.find(" ", start + SLICE_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


_OF_PROCESS: dict[str, WordTokenizer] = {}


def of_process(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, which keeps its memory from task to task."""
    if path not in _OF_PROCESS:
        _OF_PROCESS[path] = WordTokenizer(path)
    return _OF_PROCESS[path]


def forget(path: str) -> None:
    """Drop the pieces that this worker process has seen; the tokenizer stays."""
    of_process(path).forget()


def _rows(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value of so many ids for each of ``lengths``."""
    offsets = 4 * np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _merged(rows: pa.Array, starts: np.ndarray) -> pa.Array:
    """Rows between two neighbouring starts as one; their bytes stay where they are."""
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    buffers = [None, pa.py_buffer(offsets[starts]), data or pa.py_buffer(b"")]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers)


def _pieces_of(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case plain chunks as the tokenizer cuts them before it merges, and where each starts.

    That is by 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+. The pieces share the bytes.
    """
    _, offsets, data = chunks.buffers()
    if not len(chunks) or not data:
        return pa.array([], pa.string()), np.zeros(len(chunks) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]]
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    at = at[np.searchsorted(at, offsets[0]) :]
    code = raw[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    code[wide] = (code[wide] & 31) << 6 | (raw[at[wide] + 1] & 63)
    code[wide[raw[at[wide]] >= 0xE0]] = ord("x")  # three bytes: only lower case of a plain letter has them
    kind = KINDS[code]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    new = first[at]
    first = np.append(new, [True, True, True])
    new[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero(new & (code == ord("'")))
    quotes = quotes[~first[quotes + 1]]
    if len(quotes):
        code = np.append(code, [0, 0])
        one, two = code[quotes + 1], code[quotes + 2]
        two[first[quotes + 2]] = 0
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 2 * np.logical_or.reduce(pairs))
        quotes, long = quotes[long > 0], long[long > 0]
        new[quotes + 1] = False
        ends = quotes + long + 1
        new[ends[ends < len(new)]] = True
    starts = at[new]
    bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
    return pa.Array.from_buffers(pa.string(), len(starts), [None, bounds, data]), np.searchsorted(starts, offsets)


class WordTokenizer:
    """Ids as little-endian 32-bit bytes. No id spans a space or a line end, so the ids of a
    text are those of its chunks one after the other. Each different chunk of a slice is cut
    once, and a piece seen before costs a look-up; both are done by Arrow for many at a time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.ids = _rows(np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. The library's results, which are many times
        that, are made for some ``ENCODED_CHARS`` at a time."""
        step = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))) // ENCODED_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        ids, lengths = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            found = [item.ids for item in self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """Many pieces in few calls: each ends with the one id that closes a word."""
        starts = np.append(np.arange(0, len(pieces), 64, dtype=np.int32), np.int32(len(pieces)))
        ids, lengths = self._encode(pc.binary_join(pa.ListArray.from_arrays(starts, pieces), " ").to_pylist())
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(pieces) and np.array_equal(ends[starts[1:] - 1], np.cumsum(lengths)):
            return _rows(ids, np.diff(ends, prepend=0))
        return _rows(*self._encode(pieces.to_pylist()))

    def _ids_of_plain(self, chunks: pa.Array) -> pa.Array:
        if len(self.pieces) > MAX_PIECES:
            self.forget()
        pieces, starts = _pieces_of(pc.utf8_lower(chunks))
        pieces = pieces.dictionary_encode()
        at = pc.index_in(pieces.dictionary, value_set=self.pieces)
        new = pieces.dictionary.filter(at.is_null())
        if len(new):
            at = at.fill_null(-1).to_numpy().copy()
            at[at < 0] = len(self.pieces) + np.arange(len(new))
            self.ids = pa.concat_arrays([self.ids, self._encode_pieces(new)])
            self.pieces = pa.concat_arrays([self.pieces, new])
        return _merged(self.ids.take(pa.array(at).take(pieces.indices)), starts)

    def _ids_of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of different chunks; those with odd letters or special tokens go whole."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))
        odd = pc.invert(plain)
        found = pa.concat_arrays([self._ids_of_plain(chunks.filter(plain)), _rows(*self._encode(chunks.filter(odd).to_pylist()))])
        is_odd = odd.to_numpy(zero_copy_only=False)
        return found.take(pa.array(np.argsort(np.argsort(is_odd, kind="stable"), kind="stable"))) if is_odd.any() else found

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Each different chunk is encoded once; the ids are then laid out by its number."""
        split = pc.split_pattern(pc.replace_substring(pa.array(parts, pa.string()), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary
        steps = range(0, len(names), MAX_CHUNKS)
        found = pa.concat_arrays([self._ids_of_chunks(names.slice(lo, MAX_CHUNKS)) for lo in steps] or [_rows(*self._encode([]))])
        starts = split.offsets.to_numpy()
        return _merged(found.take(chunks.indices), starts - starts[:1]).to_pylist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a bounded number of characters is in work at a time."""
        found: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            for owner, ids in zip(owners, self._encode_parts(parts), strict=True):
                found[owner].append(ids)
            parts.clear()
            owners.clear()
            pa.default_memory_pool().release_unused()  # what the arrays of this slice took

        for at, text in enumerate(texts):
            for part in text_slices(text):
                parts.append(part)
                owners.append(at)
                size += len(part)
                if size >= SLICE_CHARS:
                    flush()
                    size = 0
        flush()
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
