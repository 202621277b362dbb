import re

import pytest

from tests.compare import connect, difference
from wayloom.llm import decontamination as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items, window):
    words = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORDS.findall((item or "").translate(LOWER))
        k = min(window, len(own))
        for s in range(len(own) - k + 1 if k else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[s : s + k]:
                    hit.update(range(p, p + k))
                    found.add(item_id)
    return len(words), len(hit), sorted(x for x in found if x is not None)


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, n_words string, item_id string")
    return docs, spark.createDataFrame(items, "item_id string, text string")


ITEMS = [("b", "one two three four five six"), ("a", "Alpha, BETA gamma"), ("c", "x"), ("d", ""), (None, "nu ll id"),
         ("b2", "one two three four five six"), ("e", None), ("r", "go go go go go go"), ("é", "Ünïcode été Öl word")]
TEXTS = [(1, None), (2, ""), (3, "!!! ..."), (4, "zero one two three four five six seven"), (5, "alpha beta-gamma alpha"),
         (6, "X marks x"), (7, "nu ll id then"), (8, "go " * 9), (9, "one two three four"), (9, "one two three four"),
         (None, "two three four five"), (10, "Ünïcode été Öl word"), (11, "ünïcode été öl word"), (12, "fill " * 99 + "x"),
         (13, "word " * 60_000 + "one two three four five six")]


@pytest.mark.parametrize("window", [4, 13])
def test_against_brute_force(spark, window):
    docs, items = frames(spark, TEXTS, ITEMS)
    rows = dc.screen(docs, items, window=window).collect()
    assert len(rows) == len(TEXTS)
    for r, (doc_id, text) in zip(rows, TEXTS, strict=True):
        if doc_id == 13:
            assert (r.n_words, r.n_hit, r.items) == (60_006, 6, ["b", "b2"])
            continue
        assert (r.doc_id, (r.n_words, r.n_hit, r["items"])) == (doc_id, brute(text, ITEMS, window))
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_longest_matches(spark):
    docs, items = frames(spark, TEXTS, ITEMS)
    rows = {r.doc_id: r for r in dc.screen(docs, items, window=4).collect()}
    found = {(m.item_id, m.doc_start, m.item_start, m.n_words) for m in rows[4].matches}
    assert found == {("b", 1, 0, 6), ("b2", 1, 0, 6)}
    assert {(m.item_id, m.doc_start, m.n_words) for m in rows[5].matches} == {("a", 0, 3)}


def test_no_rows_and_no_items(spark):
    docs, items = frames(spark, TEXTS, ITEMS)
    assert dc.screen(docs.limit(0), items).count() == 0
    assert dc.screen(docs, items.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        dc.screen(docs, items, max_benchmark_bytes=100)


def test_query_equals_sql(spark, sf_dir):
    query = dc.op6_benchmark_decontamination(spark, sf_dir)
    assert difference(query, connect(sf_dir), dc.ORACLE) is None
