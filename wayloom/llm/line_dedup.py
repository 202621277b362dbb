"""Line dedup by site-relative frequency: lines that a large part of a site's pages share go.

Per site, the pages that hold a line are divided by all pages of the site; a line above the
ratio is boilerplate of that site. A line counts once per page. Only hashes of lines are
shuffled, summed in each task first, so a line on a third of all pages is a few rows by then.
A site has at most (lines per page / ratio) boilerplate lines, so they fit in one row.

Copies of one page share all lines, which doesn't make these boilerplate. Where classes of
like texts are given, a line must be over the bounds by classes, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.components import components
from wayloom.llm.tables import table, written

MAX_RATIO = 0.08
MIN_PAGES = 4
# For classes of like texts: words a shingle, smallest hashes kept of a text, how many of these
# in a row name a candidate, and the part of them that like texts share.
SHINGLE_WORDS, SKETCH, RUN, ALIKE = 5, 24, 4, 0.6


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def text_keys(text: Column) -> list[Column]:
    """t1 and t2, which name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _sketch(words: Column) -> Column:
    """The smallest hashes of the word shingles, ascending; empty without words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(1)))
    hashes = F.transform(starts, lambda at: F.xxhash64(F.slice(words, at, SHINGLE_WORDS)))
    return F.when(F.size(words) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)).otherwise(F.array().cast("array<bigint>"))


def like_texts(pages: DataFrame, *, text: str = "text") -> DataFrame:
    """t1, t2, class: a class of like texts for each different text, in column expressions alone.

    Texts are candidates if some of their smallest shingle hashes stand next to each other in both
    sketches, and are linked if they share most of the sketch with the first such text. What
    links hold together is a class. A near copy may stay alone by chance; unlike texts rarely
    meet. Texts without words are classes of their own.
    """
    value = F.col(f"`{text}`")
    words = F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\s+"), lambda word: word != "")
    # Above a generator the words are made once, not once for each shingle.
    texts = pages.select(*text_keys(value), F.explode(F.array(words)).alias("words"))
    texts = texts.select("t1", "t2", _sketch(F.col("words")).alias("sketch"))
    texts = written(texts.groupBy("t1", "t2").agg(F.first("sketch").alias("sketch")), "line-texts")
    sketch, size = F.col("sketch"), F.size("sketch")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(size - (RUN - 1), F.lit(1))), lambda at: F.xxhash64(F.slice(sketch, at, RUN)))
    keyed = texts.filter(size > 0).select("t1", F.explode(F.array_distinct(runs)).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("t1").alias("b"), F.count("*").alias("n")).filter("n > 1").select("k", "b")
    met = keyed.join(shared, "k").filter("t1 <> b").select(F.col("t1").alias("a"), "b").distinct()
    one, other = (texts.select(F.col("t1").alias(c), sketch.alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b")) / F.least(F.size("of_a"), F.size("of_b"))
    links = met.join(one, "a").join(other, "b").filter(common >= ALIKE).select("a", "b")
    labels = components(links, "line-likes").select(F.col("node").alias("t1"), "label")
    return texts.select("t1", "t2").join(labels, "t1", "left").select("t1", "t2", F.coalesce("label", "t1").alias("class"))


def boilerplate(
    pages: DataFrame, *, site: str, text: str, max_ratio: float, min_pages: int, classes: DataFrame | None = None
) -> DataFrame:
    """One row per site that has boilerplate: __site and the hashes of the lines."""
    filled = F.filter(_lines(F.col(f"`{text}`")), lambda line: F.trim(line) != "")
    keys = F.array_distinct(F.transform(filled, _key))
    # A page adds one row without a line, by which the pages of the site are counted.
    keys = F.concat(F.coalesce(keys, F.array().cast("array<bigint>")), F.array(F.lit(None).cast("bigint")))
    at = F.col(f"`{site}`").alias("__site")
    if classes is None:
        rows = pages.select(at, F.explode(keys).alias("__line"))
        counts = rows.groupBy("__site", "__line").agg(F.count("*").alias("__n"))
    else:
        # Equal pages of a site meet in a partial aggregate and look up their class as one row.
        texts = pages.select(at, *text_keys(F.col(f"`{text}`")), keys.alias("__keys"))
        texts = texts.groupBy("__site", "t1", "t2").agg(F.first("__keys").alias("__keys"), F.count("*").alias("__n"))
        rows = texts.join(classes.hint("merge"), ["t1", "t2"]).select("__site", "class", "__n", F.explode("__keys").alias("__line"))
        rows = rows.groupBy("__site", "__line", "class").agg(F.sum("__n").alias("__n"))
        counts = rows.groupBy("__site", "__line").agg(F.sum("__n").alias("__n"), F.count("*").alias("__classes"))
    measures = [c for c in counts.columns if c not in ("__site", "__line")]
    often, over = F.lit(True), F.lit(True)
    for c in measures:
        often = often & (F.col(c) >= min_pages)
        over = over & (F.col(c) > F.lit(max_ratio) * F.col(f"{c}_all"))
    counts = written(counts.filter(F.col("__line").isNull() | often), "line-counts")
    totals = counts.filter("__line IS NULL").select(F.col("__site").alias("__of"), *[F.col(c).alias(f"{c}_all") for c in measures])
    frequent = counts.filter("__line IS NOT NULL").join(totals, F.expr("__site <=> __of"))
    return frequent.filter(over).groupBy("__site").agg(F.collect_list("__line").alias("__drop"))


def drop_site_lines(
    pages: DataFrame,
    *,
    site: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    classes: DataFrame | None = None,
    keep_emptied: bool = False,
) -> DataFrame:
    """All columns, the text without its site's boilerplate lines, and n_lines and n_dropped.

    A line goes if more than ``max_ratio`` of the site's pages and at least ``min_pages`` hold
    it. Lines are compared without spaces around them; blank ones are never counted or dropped,
    and the others keep their order. Pages with a null site are one site. A null text stays
    null with no lines; a page that loses all lines has an empty text. Repeated rows count as
    pages of their own. Columns named n_lines or n_dropped give way.

    ``classes`` has a row (t1, t2, class) for each different text, named by ``text_keys``. A
    line then goes only if it is over both bounds by pages and also by classes: of the site's
    classes, more than ``max_ratio`` and at least ``min_pages`` hold it. With ``keep_emptied``
    a page that would lose all its text keeps all of it.
    """
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    found = written(boilerplate(pages, site=site, text=text, max_ratio=max_ratio, min_pages=min_pages, classes=classes), "boilerplate")
    lines = _lines(F.col("p.__text"))
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col("__drop"), _key(line)))
    joined = (
        pages.select(F.col(f"`{site}`").alias("__at"), F.col(f"`{text}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("__row"))
        .alias("p").join(found, F.expr("__at <=> __site"), "left")
        .withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    )
    if keep_emptied:
        filled = F.exists("__kept", lambda line: F.trim(F.translate(line, "\t\r", "  ")) != "")
        joined = joined.withColumn("__kept", F.when(filled, F.col("__kept")))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col("__text").isNull(), 0).otherwise(n_lines).cast("long")
    values = [
        F.coalesce(F.array_join("__kept", "\n"), F.col("__text")).alias(c) if c == text else F.col("__row")[c].alias(c)
        for c in names
    ]
    dropped = F.when(F.col("__kept").isNull(), 0).otherwise(n_lines - F.size("__kept")).cast("long")
    return joined.select(*values, n_lines.alias("n_lines"), dropped.alias("n_dropped"))


def op10_line_dedup(spark, sf_dir):
    """All documents without the lines that over 8 % of their source's documents hold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_site_lines(documents).select("doc_id", "source", "text", "n_lines", "n_dropped")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
n AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT r) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT n.source, n.line FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= 4 AND n > 0.08 * pages),
k AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY i) AS text, count(*) AS kept FROM l
  WHERE NOT EXISTS (FROM b WHERE b.source IS NOT DISTINCT FROM l.source AND b.line = trim(l.line, ' ')) GROUP BY l.r)
SELECT doc_id, source, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - coalesce(kept, 0), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN k USING (r)
"""
