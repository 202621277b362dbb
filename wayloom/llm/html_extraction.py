"""Main text of web pages by a tree-structured graphical model.

Every element and every run of text of a page is a node that is main text or not. Features of
a node give its own potential, and each parent and child share one. Messages summed upward
and then downward give the exact marginal of every node; runs of text above one half are kept.

The weights are trained on labelled pages by gradient ascent of the likelihood, whose
gradient is features and pairs as labelled less those that the marginals expect. Labelled pages
are made here: a bounded sample of pages that mark their article is laid out anew in many ways, with
menus, notices, comments and other parts around and inside the article, named or unnamed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.html_tree import FEATURES, Forest, Tree, parse
from wayloom.llm.tables import long_texts, table

SAMPLE_PAGES, SAMPLE_CHARS = 200, 20_000
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class Model:
    """``weights`` by feature; ``pairs`` by child's kind (element, text), parent's and child's label."""

    weights: np.ndarray
    pairs: np.ndarray


def _sum_of_exp(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(a, axis=axis)


def marginals(model: Model, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """P(main text) of each node, and the joint of each node with its parent (parent, child)."""
    own = np.zeros((forest.size, 2))
    own[:, 1] = np.bincount(forest.nodes, weights=model.weights[forest.features], minlength=forest.size)
    pairs = model.pairs[forest.is_text]
    upward = np.zeros((forest.size, 2))
    for level in reversed(forest.levels[1:]):
        upward[level] = _sum_of_exp(pairs[level] + own[level][:, None, :], 2)
        for label in (0, 1):
            own[:, label] += np.bincount(forest.parents[level], weights=upward[level, label], minlength=forest.size)
    total, joint = own.copy(), np.zeros((forest.size, 2, 2))
    for level in forest.levels[1:]:
        rest = total[forest.parents[level]] - upward[level]
        both = pairs[level] + rest[:, :, None] + own[level][:, None, :]
        total[level] = _sum_of_exp(both, 1)
        joint[level] = np.exp(both - _sum_of_exp(both.reshape(-1, 4), 1)[:, None, None])
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


def fit(trees: list[Tree], *, steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Weights of the highest likelihood, less a penalty on their squares."""
    forest = Forest(trees)
    values = np.zeros(FEATURES + 8)
    if not trees:
        return Model(values[:FEATURES], values[FEATURES:].reshape(2, 2, 2))
    roots = forest.levels[0]
    children = np.setdiff1d(np.arange(forest.size), roots)
    labels, kinds = forest.labels, forest.is_text[children]
    at = kinds * 4 + labels[forest.parents[children]] * 2 + labels[children]
    seen_pairs = np.bincount(at, minlength=8)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        model = Model(values[:FEATURES], values[FEATURES:].reshape(2, 2, 2))
        chance, joint = marginals(model, forest)
        expected = np.stack([joint[children][kinds == kind].sum(axis=0) for kind in (0, 1)])
        gradient = np.concatenate([
            np.bincount(forest.features, weights=(labels - chance)[forest.nodes], minlength=FEATURES),
            seen_pairs - expected.ravel(),
        ]) / len(trees) - decay * values
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        values = values + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(values[:FEATURES], values[FEATURES:].reshape(2, 2, 2))


_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article>", re.S | re.I)
_MARKUP = re.compile(r"<[^>]*>|&\w+;")

# How the parts of a page may be marked up, by what they are.
WRAPPERS = (
    "<article{}>", "<main{}>", '<div class="content"{}>', '<div class="post-body"{}>', '<div id="article"{}>', '<section class="story"{}>',
    '<div role="main"{}>', '<div class="entry-content"{}>', "<div{}>", '<article class="post"{}>', '<div class="c1"{}>', "<section{}>",
)
PART_NAMES = {
    "menu": ("nav", "div.menu", "ul.nav", "div#navigation", "div.breadcrumbs", "nav.toc", "div"),
    "header": ("header", "div.header", "div#masthead", "header.site-header", "div.top", "div"),
    "footer": ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div"),
    "side": ("aside", "div.sidebar", "aside.widget", "div#sidebar", "section.rail", "div"),
    "advert": ("div.ad", "div.advert", "div.ads", "aside.sponsored", "div.promo", "section.advertisement", "div.ad-banner"),
    "notice": ("div.cookie-notice", "div#cookies", "section.notice", "div.newsletter", "div.consent", "div.alert", "aside.notice"),
    "form": ("form", "div.search", "form.login", "form#contact", "div.signup", "form.newsletter"),
    "comment": ("section.comments", "div#comments", "ol.comment-list", "div.comment", "aside.comments", "section.discussion"),
    "share": ("div.share", "div.related", "section.recommended", "ul.tags", "aside.more", "div.social"),
}


def _open(chance: random.Random, name: str, mark: str) -> tuple[str, str]:
    tag, _, rest = re.match(r"(\w+)([.#])?(.*)", name).groups()
    attribute = "" if not rest else f' {"id" if "#" in name else "class"}="{rest}"'
    if rest and tag == "div" and chance.random() < 0.08:
        attribute = ' class="x1"'
    return f"<{tag}{attribute}{mark}>", f"</{tag}>"


class PageMaker:
    """Labelled pages from the words and articles of given ones."""

    def __init__(self, articles: list[str], seed: int = 7):
        self.chance = random.Random(seed)
        plain = [" ".join(_MARKUP.sub(" ", a).split()) for a in articles] or ["some words of a text. " * 40]
        self.articles = articles or ["<h1>Some words</h1>" + "<p>" + "some words of a text. " * 12 + "</p>"]
        self.words = [w for text in plain for w in text.split()[:200]] or ["word"]

    def line(self, low: int, high: int, stop: str = "") -> str:
        start = self.chance.randrange(len(self.words))
        return " ".join(self.words[start : start + self.chance.randint(low, high)]).replace("<", "") + stop

    def _links(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self.line(1, 3)}</a>' for _ in range(self.chance.randint(low, high))]
        if self.chance.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
        return " ".join(items)

    def part(self, kind: str) -> str:
        chance = self.chance
        start, end = _open(chance, chance.choice(PART_NAMES[kind]), " data-other=1")
        prose = lambda: f"<p>{self.line(8, 60, '.')}</p>"
        if kind == "menu":
            inside = self._links(3, 9)
        elif kind == "header":
            inside = f"<h1>{self.line(1, 4)}</h1>" * (chance.random() < 0.4) + chance.choice([self.line(2, 8), self._links(2, 5), f"<p>{self.line(3, 9)}</p>"])
        elif kind == "footer":
            inside = chance.choice(["&copy; ", "", "&copy; 2024 "]) + self.line(3, 15, ".") + self._links(1, 4) * (chance.random() < 0.5)
        elif kind == "side":
            inside = f"<h3>{self.line(1, 4)}</h3>" + chance.choice([self._links(3, 7), prose(), prose() + self._links(2, 4)])
        elif kind == "advert":
            inside = chance.choice([self.line(4, 20, "."), prose(), f'<a href="/b">{self.line(3, 12)}</a>'])
        elif kind == "notice":
            inside = chance.choice([self.line(6, 30, "."), prose()]) + "<button>OK</button>" * (chance.random() < 0.6)
        elif kind == "form":
            inside = f"<label>{self.line(1, 4)}</label><input name=q>" + chance.choice(["", prose()]) + f"<button>{self.line(1, 2)}</button>"
        elif kind == "comment":
            one = lambda: f'<div class="{chance.choice(["comment", "reply", "item"])}"><b>{self.line(1, 2)}</b>{prose()}</div>'
            inside = f"<h3>{self.line(1, 3)}</h3>" * (chance.random() < 0.7) + "".join(one() for _ in range(chance.randint(1, 5)))
        else:
            inside = chance.choice([self._links(2, 6), f"<h4>{self.line(1, 3)}</h4>" + self._links(2, 5)])
        return start + inside + end

    def page(self) -> str:
        chance = self.chance
        article = chance.choice(self.articles)
        wrapper = chance.choice(WRAPPERS)
        extra = lambda kinds, p: "".join(self.part(k) for k in kinds if chance.random() < p)
        inside = extra(["share", "advert", "comment", "notice", "form", "side", "menu"], 0.12)
        blocks = re.split(r"(?=<p\b)", article)
        if chance.random() < 0.25:  # short ones, too
            blocks = blocks[: chance.randint(1, 3)]
        if chance.random() < 0.05:
            blocks = [f"<h1>{self.line(1, 5)}</h1><p><b>{self.line(1, 8)}"]
        if inside and len(blocks) > 2:
            blocks.insert(chance.randrange(1, len(blocks) + 1), inside)
        tag = re.match(r"<(\w+)", wrapper)[1]
        main = wrapper.format(" data-main=1") + "".join(blocks) + f"</{tag}>"
        before = extra(["notice"], 0.3) + extra(["header"], 0.5) + extra(["menu"], 0.8) + extra(["advert", "form", "side"], 0.4)
        after = extra(["share", "comment", "side", "form", "advert", "menu"], 0.35) + extra(["footer"], 0.85) + extra(["notice"], 0.1)
        if chance.random() < 0.4:
            before, after = before + chance.choice(['<div class="wrap">', "<div>", '<div id="page">']), "</div>" + after
        return f"<html><head><title>t</title></head><body>{before}{main}{after}</body></html>"


def train(pages: DataFrame, *, text: str = "html", sample_pages: int = SAMPLE_PAGES, made_pages: int = 900) -> Model:
    """Model from at most ``sample_pages`` pages of at most SAMPLE_CHARS that mark an article;
    they are chosen by a hash. Without any, filler words take their place."""
    html = F.col(f"`{text}`")
    marked = pages.filter(html.contains("<article") & (F.length(html) <= SAMPLE_CHARS))
    marked = marked.select(html.alias("html"), F.xxhash64(html).alias("h"))
    share = min(1.0, 2 * sample_pages / max(1, marked.count()))  # a task sends few pages, however many there are
    near = marked.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = near.dropDuplicates(["h"]).orderBy("h").limit(sample_pages).collect()
    found = [m[1] for m in (_ARTICLE.search(row["html"]) for row in rows) if m]
    maker = PageMaker(found)
    return fit([parse(maker.page()) for _ in range(made_pages)])


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    trees = [parse(page or "") for page in pages]
    forest = Forest(trees)
    chance, _ = marginals(model, forest)
    return [
        "\n".join(text for node, text in tree.texts.items() if chance[start + node] > 0.5)
        for tree, start in zip(trees, forest.starts, strict=True)
    ]


def extract(pages: DataFrame, model: Model, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text``, the main text of each page; blocks are joined by one line end.

    A null or empty page, and one without main text, has an empty text. Broken markup is read
    as far as it goes; character references are decoded; white space in a block is one space.
    A column of ``keep`` named text gives way. An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a hundred numbers or so
    names = [c for c in keep if c != "text"]
    source = pages.select(F.col(f"`{html}`").cast("string").alias("__html"), *[F.col(f"`{c}`") for c in names])
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                group, size = [], 0
                while start + len(group) < batch.num_rows and size < BATCH_CHARS:
                    group.append(batch.column(0)[start + len(group)].as_py())
                    size += len(group[-1] or "")
                part = batch.slice(start, len(group))
                texts = pa.array(main_texts(shared.value, group), pa.string())
                yield pa.RecordBatch.from_arrays(part.columns[1:] + [texts], names=[*names, "text"])
                start += len(group)

    return long_texts(source).mapInArrow(run, schema)


def op5_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
