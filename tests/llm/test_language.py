import unicodedata
import zlib

import pytest
import zstandard

from wayloom.llm.language import Classifier, LanguageModel, fit, identify, op7_language_id
from wayloom.llm.tables import table


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return fit(docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_bounded_dictionaries(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    copies = docs.limit(1).crossJoin(spark.range(500)).drop("id").union(docs)
    model = fit(copies, rows_per_language=20, dictionary_bytes=4000)
    assert set(model.dictionaries) == {"en", "de", "fr", "es"}
    assert all(len(d) <= 4000 for d in model.dictionaries.values())
    with pytest.raises(ValueError):
        fit(docs, max_languages=2)


def test_odd_rows(spark, model):
    schema = "doc_id long, text string, lang string, score string, rejected string"
    long = "the quick and the dead of this that with " * 5000
    data = [(1, None, None, "s", "r"), (2, "", "en", "s", "r"), (3, "123 ### ...", "en", "s", "r"), (4, long, None, None, None),
            (None, "a", "xx", "s", "r"), (5, "of the and that with are", "de", "s", "r"), (5, "of the and that with are", "de", "s", "r")]
    docs = spark.createDataFrame(data, schema)
    rows = identify(docs, model, min_score=0.001).collect()
    assert [r.lang_pred for r in rows[:4]] == ["und", "und", "und", "en"]
    assert [r.rejected for r in rows[:4]] == [True, True, True, False]
    assert rows[5] == rows[6] and rows[5].lang == "de" and rows[5].lang_pred == "en"
    assert identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify(docs, fit(docs.limit(0))).collect()} == {"und"}


def test_the_smallest_size_wins_and_ties_go_in_order():
    found = Classifier(LanguageModel({"b": b"uno dos tres cuatro cinco seis siete", "a": b"eins zwei drei vier fuenf sechs"}))
    assert found.classify("cuatro cinco seis siete")[0] == "b"
    assert found.classify("eins zwei drei vier fuenf")[0] == "a"
    assert found.classify("qqq")[1] == 0.0
    assert Classifier(LanguageModel({"a": b"abc"})).classify("xyz") == ("a", 1.0)


def test_copies_take_no_place_of_other_texts(spark):
    """One text holds most rows of a language; its other texts are all sampled, or as many as wanted."""
    copies = spark.range(5000).selectExpr("'ein und derselbe text' AS text", "'de' AS lang")
    others = spark.range(60).selectExpr("concat('wort', translate(id, '0123456789', 'abcdefghij'), 'ende') AS text", "'de' AS lang")
    rows = copies.union(others)
    words = set(fit(rows, rows_per_language=100).dictionaries["de"].decode().split())
    assert {r.text for r in others.collect()} < words
    few = fit(rows.filter("text LIKE 'wort%'").union(copies), rows_per_language=40).dictionaries["de"].decode().split()
    assert sum(w.startswith("wort") for w in few) in (39, 40)


def test_all_sampled_texts_have_a_place(spark):
    """Texts with one opening, of letters of two bytes, longer together than the dictionary."""
    own = "translate(id, '0123456789', 'абвгдежзик')"
    rows = spark.range(50).selectExpr(f"concat(repeat('anfang ', 200), repeat(concat('wort', {own}, 'ende '), 500)) AS text", "'de' AS lang")
    found = fit(rows, rows_per_language=50, dictionary_bytes=10_000).dictionaries["de"]
    wanted = {r.own for r in spark.range(50).selectExpr(f"concat('wort', {own}, 'ende') AS own").collect()}
    assert len(found) <= 10_000 and len(wanted & set(found.decode().split())) > 30
    short = fit(rows.limit(3), rows_per_language=50, dictionary_bytes=10_000).dictionaries["de"]
    assert 7_000 < len(short) <= 10_000


def test_numbers_that_look_like_letters_are_none(spark, model):
    texts = ["½ ² ①", "Ⅷ ⅻ 12", "_ 3 ①", "ª", "Ⅷ the of and"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert [found[i] for i in range(3)] == ["und"] * 3 and "und" not in (found[3], found[4])


def test_query_against_plain_compression(spark):
    """Every text of the smallest table, one compressor made anew for each piece and language."""
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "documents").collect()
    learned = fit(spark.createDataFrame([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1], "text string, lang string"))
    found = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in op7_language_id(spark, folder).collect()}

    def sizes(data, level):
        total = []
        for content in learned.dictionaries.values():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            squeeze = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_dict_id=False)
            total.append(sum(len(squeeze.compress(data[at : at + 1024])) for at in range(0, len(data), 1024)))
        return total

    for r in rows:
        words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in (r.text or "").lower()).split()
        want = ("und", 0.0)
        if words:
            data = " ".join(words).encode()
            for level in (5, 19):
                order = sorted(zip(sizes(data, level), learned.dictionaries, strict=True), key=lambda pair: pair[0])
                (best, name), (second, _) = order[:2]
                want = (name, (second - best) / second)
                if want[1] >= 0.03:
                    break
        assert found[r.doc_id] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, *want)
