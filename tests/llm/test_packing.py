import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayloom.llm import packing
from wayloom.llm.packing import Limits, Packer, op3_packing, pack, power_of_two_parts
from wayloom.llm.tables import table
from wayloom.llm.tokens import WordTokenizer, default_path, text_slices

ODD = [
    "", "a", "  two  spaces\n\nlines\t tab\x1cseparators wide", "It's THEY'LL ÉTÉ Straße İstanbul ΣΑΣ naïve",
    "café Å ́lone", "<|endoftext|> x<|startoftext|>y", "12345 $$$ ###!!!", "日本語 と 한국어 \U0001f600\U0001f600",
    "a" * 3000, "ŉ ſ ǆ Ⱥ", "x y\u0085z", "'S 'Re'Ve don'T",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizers(plain, spark, sf_dir):
    words = WordTokenizer(default_path())
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").limit(60).collect()] + ODD
    for text in texts:
        assert words.encode(text) == np.asarray(ids_of(plain, text)[:-1], dtype="<u4").tobytes()


def test_ids_survive_a_full_memory(plain, monkeypatch):
    monkeypatch.setattr("wayloom.llm.tokens.MAX_CHUNKS", 5)
    monkeypatch.setattr("wayloom.llm.tokens.MAX_PIECES", 5)
    words = WordTokenizer(default_path())
    for text in ["one two three four", "five six seven one two eight nine", "one ten"] + ODD:
        assert words.encode(text) == np.asarray(ids_of(plain, text)[:-1], dtype="<u4").tobytes()


def test_words_take_no_calls_of_their_own(plain):
    """Different words cost Arrow's time, not calls of Python functions for each of them."""
    words = WordTokenizer(default_path())
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j)}o{chr(97 + i // 26)}," for j in range(26)) for i in range(400)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = words.encode_all(texts)
    finally:
        sys.setprofile(None)
    assert calls < 10_400 / 2
    assert found == [np.asarray(ids_of(plain, t)[:-1], dtype="<u4").tobytes() for t in texts]


def test_the_library_gets_a_bounded_number_of_characters_at_a_time():
    """Its results are many times their texts, so they are not all made at once."""
    words = WordTokenizer(default_path())
    sizes, library = [], words.tokenizer

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sizes.append(sum(map(len, texts)))
            return library.encode_batch_fast(texts, **options)

    words.tokenizer = Watched()
    odd = [f"日本{i:05d}語" for i in range(30_000)]
    plain_words = [f"w{i:06d}" for i in range(30_000)]
    found = words.encode_all([" ".join(odd), " ".join(plain_words)])
    assert max(sizes) <= 1 << 17 < sum(sizes)
    words.tokenizer = library
    assert found == [b"".join(words.encode(t) for t in part) for part in (odd, plain_words)]


def test_every_plain_letter_is_cut_as_the_tokenizer_cuts(plain):
    letters = [chr(c) for c in range(0x21, 0x250)]
    marks = ["'s", "'ll", "'r", "'re", "--'s", "'s't", "''m", "'dx", "1²", "É'VE", "a'"]
    texts = [f"{c} a{c}b {c}{c}1{c} {c}" + f" {c}".join(marks) + c for c in letters] + ["", " ", "\n\n", "'", "' 's"]
    found = WordTokenizer(default_path()).encode_all(texts)
    assert found == [np.asarray(ids_of(plain, t)[:-1], dtype="<u4").tobytes() for t in texts]


def test_slices_join_to_the_text(monkeypatch):
    monkeypatch.setattr("wayloom.llm.tokens.SLICE_CHARS", 7)
    for text in ["", "abc", "a bc def ghij klmno p", "x" * 50, "word " * 9]:
        assert "".join(text_slices(text)) == text


def check_pieces(rows, limit=4096):
    """Each example covered once without gaps, each sequence gapless and within the limit."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_doc.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert {p[2] for p in pieces} == {at}
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_query_against_the_tokenizer(spark, sf_dir, plain):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = op3_packing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert check_pieces(rows) == 0
    for r in rows:
        ids = ids_of(plain, texts[r.doc_id])
        assert r.doc_tokens == len(ids)
        piece = np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)


@pytest.mark.parametrize("limits", [Limits(64, 4, 64), Limits(64, 8, 20), Limits(1, 1, 1), Limits(100, 3, 7)])
def test_all_limits_hold(limits):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 200, 300)
    leads = [int(rng.integers(0, n + 1)) for n in sizes]
    packer, sequences = Packer(limits, 2000, 64), []
    for key, (n, lead) in enumerate(zip(sizes, leads, strict=True)):
        sequences += packer.add(key, int(n), lead)
    sequences += packer.drain()
    seen = {}
    for sequence in sequences:
        assert sum(p[2] for p in sequence) <= limits.tokens
        assert len(sequence) <= limits.segments
        assert sum(max(0, s + n - max(s, leads[k])) for k, s, n in sequence) <= limits.loss
        for k, s, n in sequence:
            seen.setdefault(k, []).append((s, n))
    for key, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[key]):
            assert start == at
            at += length
        assert at == n


def test_the_largest_dot_product_goes_first():
    packer = Packer(Limits(10, 5, 10), 10_000)
    for key, (tokens, lead) in enumerate([(4, 0), (7, 7), (6, 0)]):
        assert not list(packer.add(key, tokens, lead))
    assert next(packer.drain()) == [(2, 0, 6), (0, 0, 4)]


def test_power_of_two_parts():
    parts = power_of_two_parts([(0, 5, 7), (1, 0, 6)], 4096)
    assert [sum(p[2] for p in part) for part in parts] == [8, 4, 1]
    assert parts[0] == [(0, 5, 7), (1, 0, 1)]


def test_odd_rows(spark, plain):
    """Null and empty texts, null and repeated keys, clashing columns, prompts, no rows."""
    schema = "doc_id long, text string, key string, ids string, sequence_id string, head string"
    long = "word " * 30_000
    data = [(1, None, "a", "b", "c", None), (2, "", "a", "b", "c", "ask me"), (None, "one two", None, None, None, None),
            (3, "same", "a", "b", "c", ""), (3, "same", "a", "b", "c", ""), (4, long, "a", "b", "c", "why")]
    frame = spark.createDataFrame(data, schema)
    rows = pack(frame, prompt="head").collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total[1] == 1 and total[3] == 2 * len(ids_of(plain, "same"))
    assert total[4] == 1 + len(ids_of(plain, long)) and total[None] == len(ids_of(plain, "one two"))
    assert sum(r.loss for r in rows if r.doc_id == 2) == 1
    assert pack(frame.limit(0)).count() == 0
    assert packing.pack(frame.withColumn("doc_id", frame.doc_id.cast("string"))).schema["doc_id"].dataType.simpleString() == "string"
