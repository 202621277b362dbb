import hashlib

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wayloom.llm import fingerprints as fp
from wayloom.llm.tables import table

SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
UNIT = regex.compile(rf"(?V1)[{SCRIPTS}]|[\p{{L}}\p{{M}}\p{{N}}--[{SCRIPTS}]]+")


def brute(text, k, w):
    """Kept (hash, position) pairs, by the definition."""
    words = []
    for x in UNIT.findall((text or "").lower()):
        n = xxhash.xxh64(x.encode(), seed=42).intdigest()
        words.append((n - (1 << 64) if n >> 63 else n) % fp.PRIME)
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = []
    for gram in grams:
        value = 0
        for x in gram:
            value = (value * fp.BASE + x) % fp.PRIME
        hashes.append(value)
    kept = []
    for i in range(max(1, len(hashes) - w + 1)) if hashes else ():
        window = hashes[i : i + w]
        least = min(window)
        at = i + max(j for j, x in enumerate(window) if x == least)
        if (least, at) not in kept:
            kept.append((least, at))
    return kept


def shown(kept):
    return " ".join(f"{h:x}@{i}" for h, i in kept)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [
    "", None, "...", "one", "one two three", "a b c d", "a b c d e f g h i j k l", "same same same same same same same same same same",
    "Ein Straßenfest, é à la carte! 12 34", "東京都に住む 人 and more", "a\nb\tc  d", "x" * 5000, "lorem ipsum " * 20_000,
]


@pytest.mark.parametrize(("k", "w"), [(4, 5), (1, 1), (3, 4), (5, 7), (6, 2)])
def test_against_brute_force(spark, k, w):
    texts = TEXTS + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(15).collect()]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, own string").drop("own")
    rows = fp.with_fingerprint(frame, "text", "own", k=k, w=w).withColumn("shown", fp.written_out(F.col("own"))).collect()
    for r in rows:
        if r.doc_id != 12:
            assert r.shown == shown(brute(texts[r.doc_id], k, w)), texts[r.doc_id]
    assert rows[12].shown


def test_match_guarantee(spark):
    shared = " ".join(f"w{i}" for i in range(fp.K + fp.W - 1))
    frame = spark.createDataFrame([(f"alpha beta {shared} gamma",), (f"{shared} other words here",)], "text string")
    a, b = (r.own for r in fp.with_fingerprint(frame, "text", "own").select(fp.hashes_of(F.col("own")).alias("own")).collect())
    assert set(a) & set(b)


def expected(docs):
    """The query's rows by brute force; docs are (doc_id, text)."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""), reverse=True)
    out = []
    for at, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(at + 1) % len(docs)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, changed, after = (brute(t, fp.K, fp.W) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(changed), alike(own, changed), alike(own, after)))
    return sorted(out, key=repr)


def actual(spark, path):
    rows = fp.op1_document_fingerprints(spark, path).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    found = actual(spark, sf_dir)
    assert found == expected(docs)
    assert sum(r[5] > r[6] for r in found) / len(found) > 0.95


@pytest.mark.parametrize("docs", [
    [], [(5, "only one here")], [(1, "a b c"), (2, None)],
    [(i * 1000, f"word {i} of text {i % 3} and so on") for i in range(60)] + [(None, "null id"), (3000, "a repeated id"), (3000, "a repeated id"), (-4, "")],
])
def test_small_tables(spark, tmp_path, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, None, None, None) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert actual(spark, str(tmp_path)) == (expected(docs) if docs else [])
