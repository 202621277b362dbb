"""The stages of the pipeline one after the other, each against brute force on its own input."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.test_decontamination import brute as windows_of
from tests.llm.test_line_dedup import brute as lines_of
from tests.llm.test_near_join import brute as classes_of
from wayloom.llm import language, line_dedup
from wayloom.llm.packing import END_ID
from wayloom.llm.tables import table, written
from wayloom.llm.tokens import WordTokenizer, default_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    """documents, and what each stage made of them."""
    found = [table(spark, SF, "documents")]
    for name, stage in pipeline.STAGES:
        found.append(written(stage(spark, found[-1], SF), f"test-{name}"))
    return found


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stage_names_and_columns(tables):
    assert len(pipeline.STAGES) == 5
    for found in tables[1:-1]:
        assert found.columns == tables[0].columns


def test_language_stage(tables):
    before, after = rows(tables[0]), rows(tables[1])
    classifier = language.Classifier(language.fit(tables[0]))
    wanted = {i for i, r in before.items() if (found := classifier.classify(r.text))[0] != "und" and found[1] >= language.MIN_SCORE}
    assert set(after) == wanted and len(wanted) > 0.95 * len(before)
    assert all(before[i] == after[i] for i in wanted)


def test_line_stage(tables):
    before, after = rows(tables[1]), rows(tables[2])
    expected = lines_of([(r.doc_id, r.source, r.text) for r in before.values()], line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    kept = {i: text for i, text, _, gone in expected if not gone or text.strip()}
    assert {i: r.text for i, r in after.items()} == kept
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_join_stage(tables):
    before, after = list(tables[2].collect()), rows(tables[3])
    found = classes_of([(r.doc_id, r.text) for r in before])
    assert set(after) == {class_id for class_id, _, _ in found}
    assert all(r == after[r.doc_id] for r in before if r.doc_id in after)


def test_decontamination_stage(spark, tables):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = rows(tables[3]), rows(tables[4])
    chosen = sorted(before)[::7] + sorted(set(before) - set(after))
    for doc_id in chosen:
        n, hit, _ = windows_of(before[doc_id].text, items, 13)
        assert (doc_id in after) == (not (hit and 20 * hit >= n))


def test_packing_stage(tables):
    words = WordTokenizer(default_path())
    texts = rows(tables[4])
    found = {}
    for r in tables[5].collect():
        found.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    end = END_ID.to_bytes(4, "little")
    assert {i: b"".join(ids for _, ids in sorted(p)) for i, p in found.items()} == {
        i: words.encode(r.text) + end for i, r in texts.items()
    }


def test_run_is_the_stages(spark, tables):
    key = lambda r: (r.doc_id, r.start, r.length, bytes(r.ids))
    made = entry.queries()["pipeline"](spark, SF)
    assert Counter(map(key, made.collect())) == Counter(map(key, tables[-1].collect()))


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, and an empty table run through all stages."""
    good = table(spark, SF, "documents").filter("doc_id >= 100").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "### 123", None, "s", 7),
                                 (3, "the of and to in is that for " * 9000, "en", None, None)] + [(4, "the same of and the other for it", "en", "s", 1)] * 3, SCHEMA)
    for at, frame in enumerate((good.unionAll(odd), good.limit(0))):
        path = f"{tmp_path}/{at}"
        frame.write.parquet(f"{path}/documents.parquet")
        table(spark, SF, "benchmark").write.parquet(f"{path}/benchmark.parquet")
        ids = {r.doc_id for r in pipeline.run(spark, path).collect()}
        assert ids.isdisjoint({None, 1, 2}) and (not at) == (3 in ids)


def test_large_groups_of_copies_keep_one(spark):
    """A source where exact copies are a third of the pages and near copies another, and a small one."""
    words = lambda seed, n: " ".join(f"w{seed * 7919 + i * 31 % 977}" for i in range(n))
    exact = "\n".join(words(1000 + k, 12) for k in range(4))
    near = [words(2000 + k, 40) for k in range(6)]
    data = [(i, f"menu of the site\n{words(i, 60)}", "big") for i in range(30)]
    data += [(i, exact, "big") for i in range(100, 130)]
    data += [(i, "\n".join(near[:5] + [f"{near[5]} edit{i} here{i}"]), "big") for i in range(200, 230)]
    data += [(i, words(i, 60), "small") for i in range(300, 320)] + [(i, exact + "\nof the small site", "small") for i in range(400, 404)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in data], SCHEMA)
    cleaned = written(pipeline.drop_site_lines(spark, docs, SF), "test-copies-lines")
    menu = "menu of the site\n"
    assert {i: r.text for i, r in rows(cleaned).items()} == {i: t.removeprefix(menu) for i, t, _ in data}
    left = rows(pipeline.join_near_duplicates(spark, cleaned, SF))
    assert {i for i in left if 100 <= i < 300} == {100, 200} and left[200].text == data[60][1]
    assert set(range(30)) <= set(left) and set(range(300, 320)) <= set(left)
