import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import connect, difference
from wayloom.llm.substring_dedup import ORACLE, op9_substring_dedup, remove_repeats, rightmost_least

WORD = re.compile(r"[^\x20\x09-\x0D]+")

def brute(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[s : s + window]) for w in split for s in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for i in range(s, s + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def made_texts():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(30)}"
    passage = [[word() for _ in range(n)] for n in (12, 13, 20, 40, 90)]
    texts = [None, "", " \n\t ", "short text", "a b c d e"]
    for _ in range(60):
        words = []
        for _ in range(rng.integers(1, 5)):
            words += [word() for _ in range(rng.integers(0, 25))]
            source = passage[rng.integers(len(passage))]
            a = rng.integers(0, len(source) - 8)
            words += source[a : a + rng.integers(8, 60)]
        texts.append("  ".join(words))
    return texts + texts[-3:] + [texts[-1]] * 3 + ["la " * 100, "la " * 11, "x y " * 30, "once " + " ".join(map(str, range(3000)))]


@pytest.mark.parametrize(("window", "gram"), [(12, 4), (12, 12), (10, 1), (35, 8)])
def test_against_brute_force(spark, window, gram):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, row string, n_words string")
    rows = remove_repeats(docs, window=window, gram=gram, keep=("doc_id", "row", "n_words")).collect()
    assert len(rows) == len(texts)
    expected = brute(texts, window)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]
        assert r.n_removed == sum(s.n_words for s in r.spans) and r.row == "a"
    assert any(r.n_removed for r in rows)


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=4)


@pytest.mark.parametrize("chunk", [7, 1 << 23])
def test_rightmost_least(monkeypatch, chunk):
    monkeypatch.setattr("wayloom.llm.substring_dedup._CHUNK", chunk)
    values = np.random.default_rng(1).integers(0, 6, 200).astype(np.uint64) << np.uint64(30)
    for width in (1, 2, 5, 28, 200, 201):
        expected = [max(range(i, i + width), key=lambda j: (-int(values[j]), j)) for i in range(200 - width + 1)]
        assert rightmost_least(values, width).tolist() == expected


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert difference(op9_substring_dedup(spark, path), connect(path), ORACLE) is None
