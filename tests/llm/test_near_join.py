from collections import defaultdict

import numpy as np
import pytest

from tests.compare import connect, difference
from wayloom.llm import near_join as nj
from wayloom.llm.components import components
from wayloom.llm.near_join import keep_one_of_each, near_classes


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, threshold=0.8):
    """(class id, documents of the class, links) of each row, in order."""
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    pairs = {(i, j) for g in by_shingle.values() if len(g) < 500 for i in g for j in g if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(n):
        members[find(i)].append(docs[i][0])
    least = {r: min((k for k in m if k is not None), default=None) for r, m in members.items()}
    return [(least[find(i)] if links[i] else docs[i][0], len(members[find(i)]), links[i]) for i in range(n)]


def compare(spark, docs, **options):
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], "doc_id long, text string, node string, id string")
    rows = near_classes(frame, **options).collect()
    found = sorted(((r.doc_id, r.class_id, r.n_class, r.n_links) for r in rows), key=repr)
    assert found == sorted(((k, *b) for (k, _), b in zip(docs, brute(docs), strict=True)), key=repr)


def edited(rng, words, share):
    out = list(words)
    for at in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def documents():
    rng = np.random.default_rng(11)
    docs = [(None, "a text whose key is null and long enough"), (1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "Two  WORDS"), (6, "lone")]
    at = 10
    for _ in range(30):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(20, 150))]
        docs.append((at, " ".join(base)))
        for _ in range(rng.integers(0, 5)):
            at += 1
            docs.append((at, edited(rng, base, rng.choice([0.005, 0.02, 0.06]))))
        at += 1
    docs += [docs[8]] * 3 + [(500, docs[9][1]), (None, docs[9][1]), (600, "long " * 30_000), (601, "long " * 30_001)]
    return docs


def test_against_brute_force(spark, documents):
    compare(spark, documents)


def test_blocks_give_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 2)
    compare(spark, documents)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert difference(nj.op4_ngram_jaccard_join(spark, path), connect(path), nj.ORACLE) is None


def test_one_of_each_stays(spark, documents):
    schema = "doc_id long, text string, row string, class_id long"
    frame = spark.createDataFrame([(k, t, "r", 7) for k, t in documents], schema)
    kept = [(r.doc_id, r.text) for r in keep_one_of_each(frame).collect()]
    assert keep_one_of_each(frame).columns == frame.columns
    groups = defaultdict(set)
    for (key, text), (class_id, size, _) in zip(documents, brute(documents), strict=True):
        groups[(class_id, size) if size > 1 else (key, text)].add((key, text))
    assert len(kept) == len(groups)
    for members in groups.values():
        assert len(members & set(kept)) == 1
        assert min(members, key=lambda m: (m[0] is None, m[0] or 0))[0] in {m[0] for m in members & set(kept)}


def test_no_rows(spark, documents):
    frame = spark.createDataFrame(documents[:4], "doc_id long, text string")
    assert near_classes(frame.limit(0)).count() == 0 and keep_one_of_each(frame.limit(0)).count() == 0
    assert keep_one_of_each(frame).count() == 4


def test_depth_and_recall():
    depth = nj.match_depth(0.8, 28, 8, 0.998)
    assert nj.recall(0.8, 28, depth) >= 0.998 > nj.recall(0.8, 28, depth + 1)
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2))
        keys = nj.prefix_keys(nj.signatures([a, b], 28 * 8), 28, 8, depth)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 197


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert found == root
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_pairs_at_the_threshold_meet(spark):
    """Isolated pairs just over the threshold: 5,000 pairs share a prefix in some tree, each of them."""
    depth = nj.match_depth(nj.THRESHOLD, nj.TREES, nj.MAX_DEPTH, nj.TARGET_RECALL)
    assert nj.recall(0.8, nj.TREES, depth) > 0.999999
    assert depth == nj.MAX_DEPTH  # no minhash is computed for nothing
    rng = np.random.default_rng(3)
    for _ in range(50):
        sets = []
        for _ in range(100):
            common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
            sets += [np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) for _ in range(2)]
        keys = nj.prefix_keys(nj.signatures(sets, nj.TREES * nj.MAX_DEPTH), nj.TREES, nj.MAX_DEPTH, depth)
        assert (keys[::2] == keys[1::2]).any(axis=1).all()
