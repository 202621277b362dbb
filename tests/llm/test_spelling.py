import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.compare import connect, difference
from wayloom.llm import spelling
from wayloom.llm.spelling import ORACLE, gap_keys, op11_spelling_variants, spelling_variants, word_counts

DOCS = "doc_id long, text string"


def brute_counts(rows, typo_every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if typo_every and doc_id is not None and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, factor=10):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) < 2 and a != b and one_apart(a, b):
                near[a].append(b)
    form = {}
    for word, others in near.items():
        n, best = min((-counts[b], b) for b in others)
        if -n >= factor * counts[word]:
            form[word] = best
    found = {}
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        found[word] = (form.get(word), root, n, len(near[word]), counts.get(form.get(word)))
    return found


def result(frame):
    rows = frame.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def counted(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_few_letters_give_many_neighbours(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abÿ") for _ in range(draw.randint(7, 10))): draw.choice([2, 3, 30, 400, 9000]) for _ in range(500)}
    words |= {"a" * n: 10**n for n in range(7, 13)} | {"aaaaaab": 2, "baaaaaa": 2}
    found = result(spelling_variants(counted(spark, words)))
    assert found == brute(words)
    assert found["aaaaaaa"][1] == "a" * 12  # a chain of forms


def test_longer_than_the_walk(spark, monkeypatch):
    base = "".join(random.Random(5).choice("abc") for _ in range(3_000))
    words = {base: 50, base[:10] + base[11:]: 2, base[:2_990] + "x" + base[2_991:]: 4, base + "zz": 3, "y" + base: 5, base[1:]: 2}
    edge = base[: spelling.MAX_WALKED]
    words |= {edge: 20, edge + "q": 2, edge[:-1]: 2, edge[:50] + "ÿ" + edge[50:]: 2, edge + "qq": 2}
    assert result(spelling_variants(counted(spark, words))) == brute(words)
    draw = random.Random(8)
    short = {"".join(draw.choice("ab") for _ in range(draw.randint(7, 11))): draw.randint(2, 50) for _ in range(200)}
    monkeypatch.setattr(spelling, "MAX_WALKED", 9)
    assert result(spelling_variants(counted(spark, short))) == brute(short)


def test_gap_keys():
    without, gaps, whole = gap_keys("abcb")
    assert [int(h) for h in without] == [gap_keys(w)[2] for w in ("bcb", "acb", "abb", "abc")]
    assert int(gaps[1]) == int(gap_keys("axcb")[1][1]) != int(gap_keys("axcd")[1][1])
    assert whole != gap_keys("abbc")[2]


def test_words_of_documents(spark):
    draw = random.Random(11)
    names = ["Straßen", "ÉTAGÈRE", "longword", "longwords", "Langword", "x" * 7, "×÷×÷×÷×"]
    rows = [(i, " ".join(draw.choice(names) + draw.choice(["", ".", "1", "Ā"]) for _ in range(80))) for i in range(40)]
    rows += [(None, "longword longword"), (50, None), (51, ""), (52, "short words only"), rows[0], rows[0], (60, "longword, " * 30_000)]
    for every in (None, 3, 31):
        frame = spark.createDataFrame(rows, DOCS)
        counts = {r.word: r.n for r in word_counts(frame, typo_every=every).collect()}
        assert counts == brute_counts(rows, every)
    assert result(spelling_variants(word_counts(frame, typo_every=3))) == brute(brute_counts(rows, 3))


def test_other_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "abcdefg abcdefg", "x", 5)], "key long, run string, word string, n int")
    assert [tuple(r) for r in word_counts(frame, key="key", text="run").collect()] == [("abcdefg", 2)]
    assert spelling_variants(word_counts(frame.limit(0), key="key", text="run")).count() == 0
    alone = spelling_variants(word_counts(frame, key="key", text="run")).collect()
    assert [tuple(r) for r in alone] == [("abcdefg", None, "abcdefg", 2, 0, None)]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert difference(op11_spelling_variants(spark, folder), connect(folder), ORACLE) is None
