"""A page's elements and runs of text as a tree, with the features of each node."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-main|data-other)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's element kinds, and words that sites use to name the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article body nav aside main form footer header".split())
TAGS = (
    "html body div section article main nav header footer aside form button p li ul ol dl dt dd table tr td h1 h2 h3 h4 "
    "figure figcaption blockquote pre a fieldset details other"
).split()
HINTS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead top topbar hero brand logo site",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets secondary column",
    "advert": "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner commercial",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe paywall privacy announcement",
    "form": "form search login signin signup register contact input field",
    "comment": "comment comments commenter reply replies respond discussion disqus thread review reviews feedback",
    "share": "share sharing social related recommended recommendations trending popular more tags meta byline author",
    "content": "article content main post entry body story text blog page prose",
}
_TAG_AT = {tag: at for at, tag in enumerate(TAGS)}
_HINT_AT = {word: at for at, words in enumerate(HINTS.values()) for word in words.split()}

LENGTHS, LINKS, SHARES = (20, 60, 150, 400), (0.01, 0.5), (0.05, 0.2, 0.5)
_T, _H = len(TAGS), len(HINTS)
# Where each group of features starts: first those of elements, then those of text.
E_BIAS, E_TAG, E_HINT = 0, 1, 1 + _T
E_LINK, E_SHARE, E_LENGTH = E_HINT + _H, E_HINT + _H + 3, E_HINT + _H + 7
L_BIAS = E_LENGTH + 5
L_TAG, L_LENGTH, L_LINK, L_END, L_SIGN, L_PLACE = L_BIAS + 1, L_BIAS + 1 + _T, L_BIAS + 6 + _T, L_BIAS + 9 + _T, L_BIAS + 10 + _T, L_BIAS + 11 + _T
FEATURES = L_PLACE + 3
# Elements nested deeper are siblings at this depth, as browsers lay them out.
MAX_DEPTH = 512


class Tree:
    """Nodes in page order. Node 0 is the page; ``texts`` has the runs of text by node."""

    def __init__(self):
        self.parents, self.depths, self.tags, self.names = [0], [0], ["html"], [""]
        self.texts: dict[int, str] = {}
        self.links: dict[int, int] = {}
        self.labels = [0]

    def add(self, parent: int, tag: str, names: str, label: int) -> int:
        if self.depths[parent] >= MAX_DEPTH:
            parent = self.parents[parent]
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.tags.append(tag)
        self.names.append(names)
        self.labels.append(label)
        return len(self.parents) - 1


def _end_of_raw(page: str, tag: str, start: int, endless: set[str]) -> int:
    """Where the element's content ends; scripts end at their first end tag whatever is in them.

    A tag without one from here on goes to ``endless`` and is not looked for again.
    """
    found = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, start)
    if found:
        return found.start()
    endless.add(tag)
    if tag == "head":
        body = re.compile(r"<body\b", re.I).search(page, start)
        return body.start() if body else len(page)
    return len(page)


def parse(page: str) -> Tree:
    """Tree of a page. Elements without text of their own kind (scripts, styles, the head, form
    choices) are left out, inline elements belong to the block around them."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("html", 0)]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements above the first, by tag
    endless: set[str] = set()  # raw elements of which no end tag follows
    run: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                node = tree.add(stack[-1][1], "#text", "", tree.labels[stack[-1][1]])
                tree.texts[node] = text
                tree.links[node] = min(linked, len(text))
            run.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            run.append(plain)
            if in_link:
                linked += len(plain.strip())

    def pop_to(depth: int) -> None:
        flush()
        for closed, _ in stack[depth:]:
            places[closed].pop()
        del stack[depth:]

    def nearest(tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none."""
        return max((places[name][-1] for name in tags if places.get(name)), default=0)

    at = 0
    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            rest = page[at:]
            # A tag cut off by the end of the page is no text.
            text(rest)
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                continue
            if places.get(tag):
                pop_to(places[tag][-1])
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = found[3]
        if attributes.endswith("/") and tag in ("svg", "iframe", "object"):
            continue
        if tag in RAW:
            at = _end_of_raw(page, tag, at, endless)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link += 1
            continue
        flush()
        in_link = 0
        if tag == "html" or tag == "body" and places.get(tag):
            continue
        closed = nearest(("p", *CLOSES.get(tag, ())))
        if closed and closed >= nearest(SCOPES):
            pop_to(closed)
        names, label = "", tree.labels[stack[-1][1]]
        if attributes and "=" in attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "data-main":
                    label = 1
                elif name == "data-other":
                    label = 0
                else:
                    names += " " + value
        places[tag].append(len(stack))
        stack.append((tag, tree.add(stack[-1][1], tag, names, label)))
    flush()
    return tree


def hints(names: str) -> set[int]:
    return {_HINT_AT[w.lower()] for w in _NAME.findall(names) if w.lower() in _HINT_AT} if names else set()


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= edge for edge in edges)


def features(tree: Tree) -> tuple[list[int], list[int]]:
    """(node, feature) pairs of all present features."""
    n = len(tree.parents)
    chars, linked, runs = [0] * n, [0] * n, [0] * n
    for node, text in tree.texts.items():
        chars[node], linked[node], runs[node] = len(text), tree.links[node], 1
    for node in range(n - 1, 0, -1):
        parent = tree.parents[node]
        chars[parent] += chars[node]
        linked[parent] += linked[node]
        runs[parent] += runs[node]
    total = max(1, chars[0])
    nodes, found = [], []
    before = 0
    for node in range(n):
        link = _bin(linked[node] / max(1, chars[node]), LINKS)
        text = tree.texts.get(node)
        if text is not None:
            own = [
                L_BIAS, L_TAG + _TAG_AT.get(tree.tags[tree.parents[node]], _T - 1), L_LENGTH + _bin(len(text), LENGTHS),
                L_LINK + link, L_PLACE + (0 if before < 0.1 * total else 2 if before > 0.9 * total else 1),
            ]
            if text[-1] in ".!?…。\"'”)":
                own.append(L_END)
            if "©" in text or "®" in text:
                own.append(L_SIGN)
            before += len(text)
        else:
            own = [
                E_BIAS, E_TAG + _TAG_AT.get(tree.tags[node], _T - 1), E_LINK + link, E_SHARE + _bin(chars[node] / total, SHARES),
                E_LENGTH + _bin(chars[node] / max(1, runs[node]), LENGTHS),
            ]
            own += [E_HINT + h for h in hints(tree.names[node])]
        nodes += [node] * len(own)
        found += own
    return nodes, found


class Forest:
    """Several trees side by side, as arrays."""

    def __init__(self, trees: list[Tree]):
        parents, nodes, found = [], [], []
        self.starts = []
        at = 0
        for tree in trees:
            self.starts.append(at)
            own_nodes, own_features = features(tree)
            parents.append(np.asarray(tree.parents) + at)
            nodes.append(np.asarray(own_nodes) + at)
            found.append(np.asarray(own_features))
            at += len(tree.parents)
        self.size = at
        self.parents = np.concatenate(parents) if trees else np.zeros(0, dtype=np.int64)
        self.nodes = np.concatenate(nodes) if trees else np.zeros(0, dtype=np.int64)
        self.features = np.concatenate(found) if trees else np.zeros(0, dtype=np.int64)
        depths = np.array([d for tree in trees for d in tree.depths], dtype=np.int64)
        self.is_text = np.array([tag == "#text" for tree in trees for tag in tree.tags], dtype=np.int64)
        self.labels = np.array([label for tree in trees for label in tree.labels], dtype=np.int64)
        order = np.argsort(depths, kind="stable")
        cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2 if at else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
