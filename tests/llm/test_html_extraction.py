import itertools
import re
import time
from html import unescape

import numpy as np
import pytest

from wayloom.llm.html_extraction import Model, PageMaker, extract, fit, main_texts, marginals, op5_html_extraction, train
from wayloom.llm.html_tree import FEATURES, MAX_DEPTH, Forest, Tree, parse
from wayloom.llm.tables import table


@pytest.fixture(scope="module")
def model(spark):
    return train(table(spark, "/root/testdata/sf0.01", "pages"))


def small_trees():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9):
        tree = Tree()
        for node in range(1, size):
            tree.add(int(rng.integers(0, node)), str(rng.choice(["div", "p", "#text"])), str(rng.choice(["", "menu", "content ad"])), int(rng.integers(0, 2)))
        tree.texts = {n: "some words." for n in range(size) if tree.tags[n] == "#text"}
        tree.links = dict.fromkeys(tree.texts, 0)
        yield tree


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    model = Model(rng.normal(size=FEATURES), rng.normal(size=(2, 2, 2)))
    trees = list(small_trees())
    together, joint = marginals(model, Forest(trees))
    at = 0
    for tree in trees:
        forest = Forest([tree])
        n = forest.size
        unary = np.bincount(forest.nodes, weights=model.weights[forest.features], minlength=n)
        chance, pair, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(unary[i] * y for i, y in enumerate(labels))
            score += sum(model.pairs[forest.is_text[i], labels[tree.parents[i]], labels[i]] for i in range(1, n))
            weight = np.exp(score)
            total += weight
            chance += weight * np.array(labels)
            for i in range(1, n):
                pair[i, labels[tree.parents[i]], labels[i]] += weight
        np.testing.assert_allclose(together[at : at + n], chance / total)
        np.testing.assert_allclose(joint[at : at + n], pair / total, atol=1e-12)
        at += n


def test_training_raises_the_likelihood_of_labels():
    trees = list(small_trees()) * 5
    forest = Forest(trees)
    chance, _ = marginals(fit(trees, steps=60), forest)
    assert np.where(forest.labels == 1, chance, 1 - chance).mean() > 0.6
    assert not fit([]).weights.any()


def test_held_out_layouts(model, spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages").select("html").limit(60).collect()
    found = [m[1] for m in (re.search(r"<article>(.*?)</article>", r.html, re.S) for r in pages) if m]
    maker = PageMaker(found, seed=991)
    forest = Forest([parse(maker.page()) for _ in range(200)])
    chance, _ = marginals(model, forest)
    runs = forest.is_text == 1
    assert ((chance > 0.5) == (forest.labels == 1))[runs].mean() > 0.98


def wanted(page):
    """The article of a page of the given tables."""
    inside = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*(?:>|\Z)", inside.replace("<br>", " "))
    return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", "", x)).split()) for x in blocks) if b)


def test_given_pages(spark):
    source = {r.page_id: r for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = op5_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id for r in rows} == set(source)
    assert all(r.n_chars == len(r.text) and r.url == source[r.page_id].url for r in rows)
    assert sum(r.text == wanted(source[r.page_id].html) for r in rows) / len(rows) > 0.98


RICH = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Site name</a></header>
<nav class=menu><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site. <button>Accept</button></div>
<article><h1>A &amp; B</h1><p>First   paragraph of the main text, with a <a href="x">link</a> in&nbsp;it, and more words to read.
<p>Second paragraph<br>goes on &lt;here&gt; with some further words that make it long enough to be read as text.</p>
<div class="advert">Buy now, cheap offers today only.</div>
<p>Third paragraph of the main text closes the article with enough words in it to be believed.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I liked this text a lot, thanks for it.</p></div></section>
<aside class="sidebar"><h3>More</h3><ul><li><a href="/c">Three</a></ul></aside>
<form class="login"><label>Name</label><input><button>Go</button></form>
<footer>&copy; 2024 Site name. All rights reserved.</footer></body></html>"""


def test_parts_that_are_no_main_text(model):
    assert main_texts(model, [RICH])[0] == (
        "A & B\nFirst paragraph of the main text, with a link in it, and more words to read.\n"
        "Second paragraph goes on <here> with some further words that make it long enough to be read as text.\n"
        "Third paragraph of the main text closes the article with enough words in it to be believed."
    )


def test_odd_rows(spark, model):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    broken = ["<", "<a", "<p", "</", "<p class=\"x", "a < b & c &unknown; &#x41;", "<script>", "<!-- open", "</p></div>", "<p>" * 50, "<title>x", "&", "\x00"]
    long = "<article>" + "<p>" + "long words of a text " * 50_000 + "</article>"
    data = [(i, "u", h, "t") for i, h in enumerate([None, "", deep, long, *broken])] + [(None, None, RICH, "t")] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    rows = extract(pages, model, keep=("page_id", "url", "text")).collect()
    assert rows[0].text == rows[1].text == "" and len(rows) == len(data)
    assert len(rows[3].text) == 50_000 * len("long words of a text ") - 1
    assert rows[-1].text == rows[-2].text != ""
    assert extract(pages.limit(0), model).count() == 0
    assert train(pages.limit(0), made_pages=20).weights.any()


@pytest.mark.parametrize("page", [
    "<x>" * 200_000 + "deep", "</x>" * 200_000 + "text", "<x></y>" * 100_000, "<p><x>" * 100_000, "<head><body>" * 50_000,
    "<div>" * 100_000 + "text" + "</div>" * 100_000, "<li><ul>" * 80_000,
])
def test_broken_nesting_takes_linear_time(page):
    start = time.monotonic()
    tree = parse(page)
    assert max(tree.depths) <= MAX_DEPTH + 1 and sum(map(len, tree.texts.values())) == len(re.sub("<[^>]*>", "", page))
    chance, _ = marginals(fit([]), Forest([tree]))
    assert len(chance) == len(tree.parents)
    assert time.monotonic() - start < 20
