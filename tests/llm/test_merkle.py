import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.compare import connect, difference
from wayloom.llm import merkle
from wayloom.llm.merkle import ORACLE, append_logs, block_log, document_leaves, log_nodes, op12_merkle_manifest, position, prove

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """(doc_id, leaf, subroot, root, siblings, folded root) of each row."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        sources[source].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        trees.append(levels([leaf(r) for r in sources[source]]))
    top = levels([tree[-1][0] for tree in trees])
    found = []
    for k, source in enumerate(order):
        for i, row in enumerate(sources[source]):
            *head, text = row
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h, proof = leaf((*head, text)), ""
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    run, slot = level[at - at % 16 : at - at % 16 + 16], at % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    h, at = sha("".join([*run[:slot], h, *run[slot + 1 :]])), at // 16
            found.append((row[0], trees[k][0][i], trees[k][-1][0], top[-1][0], proof, h))
    return sorted(found, key=repr)


def proved(frame):
    names = ("digest", "subroot", "root", "siblings", "folded_root")
    return sorted(((r.key, *(bytes(r[n]).hex() for n in names)) for r in prove(document_leaves(frame)).collect()), key=repr)


def postorder(leaves, level, index, top):
    """Nodes below and including one, by recursion."""
    if level:
        for child in range(index * 16, min(index * 16 + 16, -(-leaves // 16 ** (level - 1)))):
            yield from postorder(leaves, level - 1, child, top)
    yield level, index


def test_positions_and_logs():
    for leaves in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4097, 5000):
        top = merkle.height(leaves)
        nodes = list(postorder(leaves, top, 0, top))
        assert [position(level, index, leaves, top) for level, index in nodes] == list(range(len(nodes)))
    for leaves in (1, 3, 16, 33, 272, 4096):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(leaves)]
        tree = levels([d.hex() for d in digests])
        while len(tree) < 4:
            tree.append([sha(tree[-1][0])])
        assert [n.hex() for n in block_log(digests)] == [tree[level][i] for level, i in postorder(leaves, 3, 0, 3)]


def test_against_brute_force(spark):
    draw = random.Random(2)
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "é": 300, None: 20, "": 5, "hot": 9_000} | {f"s{i}": 1 for i in range(30)}
    rows = [(n * 10_000 + i, s, draw.choice(["de", None]), draw.choice([3, None]), draw.choice(["Text É", None, "", "low"])) for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    rows += [(None, "a", None, None, "X"), (None, "a", "de", None, "Y"), (7, "b", None, 2, "LONG " * 50_000)] + [rows[20]] * 20
    draw.shuffle(rows)
    assert proved(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_log(spark):
    rows = [(i, source, None, None, str(i)) for source, size in (("a", 4_500), ("b", 40), ("c", 1)) for i in range(size)]
    stages = append_logs(document_leaves(spark.createDataFrame(rows, DOCS)).select("tree", "place", "digest"))
    assert len(stages) == 2
    found = defaultdict(dict)
    for r in log_nodes(stages).collect():
        assert r.position not in found[r.tree]
        found[r.tree][r.position] = (r.level, r["index"], bytes(r.digest).hex())
    for source, size in (("a", 4_500), ("b", 40), ("c", 1)):
        tree = levels([leaf(r) for r in rows if r[1] == source])
        want = [(level, i, tree[level][i]) for level, i in postorder(size, len(tree) - 1, 0, len(tree) - 1)]
        assert [found[f"s{source}"][p] for p in range(len(want))] == want == [found[f"s{source}"][p] for p in sorted(found[f"s{source}"])]


def test_few_rows_and_other_columns(spark):
    one = spark.createDataFrame([(None, None, None, None, None, "k", 1)], f"{DOCS}, key string, place int")
    [row] = proved(one)
    assert row == (None, sha("-----"), sha("-----"), sha("-----"), "", sha("-----"))
    assert proved(one.limit(0)) == []


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert difference(op12_merkle_manifest(spark, folder), connect(folder), ORACLE) is None
