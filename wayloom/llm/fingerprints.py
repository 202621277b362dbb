"""Document fingerprints by winnowing, in column expressions alone.

Words are hashed, k-grams of them get a rolling hash, and of each window of w neighbouring
k-grams the smallest is kept, the rightmost of equal ones, with its position. Two texts that
share w + k - 1 words in a row share a kept hash.

A rolling hash of n words is made of those of two parts, and a minimum over a window of two
overlapping ones, so a text costs a few passes over its words whatever k and w are.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.tables import table

K, W = 4, 5
PRIME = (1 << 31) - 1
BASE = 1_000_003
# Words; scripts that are written without spaces count by letter.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+"


def with_fingerprint(frame: DataFrame, text: str, name: str, *, k: int = K, w: int = W) -> DataFrame:
    """Adds ``name``: the kept marks of the text in order of their positions, each
    hash * 2**31 + (2**31 - 1 - position). Fewer than k words are one gram; no words, null
    and empty texts have no marks."""
    made: list[str] = []

    def step(part: str, value: Column) -> Column:
        """A column of its own for each pass, so that no pass is done twice."""
        nonlocal frame
        made.append(f"__{name}_{part}")
        frame = frame.withColumn(made[-1], value)
        return F.col(made[-1])

    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(UNIT), F.lit(0))
    words = step("words", F.transform(found, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    count = step("count", F.size(words))
    rolled = {1: words}

    def roll(n: int) -> Column:
        """Hash of each n words in a row; empty if there are fewer."""
        if n not in rolled:
            a = n // 2 if n % 2 == 0 else n - 1
            left, right, factor = roll(a), roll(n - a), pow(BASE, n - a, PRIME)
            length = F.greatest(count - (n - 1), F.lit(0))
            rolled[n] = step(f"gram{n}", F.zip_with(
                F.slice(left, 1, length), F.slice(right, a + 1, length), lambda x, y: (x * factor + y) % PRIME
            ))
        return rolled[n]

    short = F.array(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME))
    grams = F.when(count >= k, roll(k)).when(count > 0, short).otherwise(words)
    marks = step("marks", F.transform(grams, lambda x, i: x * (1 << 31) + (F.lit(PRIME) - i)))
    total = step("total", F.size(marks))
    minima, span = marks, 1
    while span < w:
        ahead = min(span, w - span)
        span += ahead
        length = F.greatest(total - (span - 1), F.lit(0))
        minima = step(f"least{span}", F.zip_with(
            F.slice(minima, 1, length), F.slice(minima, ahead + 1, length), lambda x, y: F.least(x, y)
        ))
    fewer = F.when(total > 0, F.array(F.array_min(marks))).otherwise(marks)
    kept = F.when(total < w, fewer).otherwise(minima)
    return frame.withColumn(name, F.array_distinct(kept)).drop(*made)


def hashes_of(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 31)))


def written_out(marks: Column) -> Column:
    """``hash@position`` in hexadecimal and decimal, one space between; empty if there are none."""
    return F.array_join(
        F.transform(marks, lambda m: F.concat(F.lower(F.hex(F.shiftright(m, 31))), F.lit("@"), F.lit(PRIME) - m % (1 << 31))), " "
    )


def likeness(a: Column, b: Column) -> Column:
    """Common hashes among all of two texts, 0 to 1; two texts without any are alike."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, 1.0).otherwise(common / total)


def with_next_row(frame: DataFrame, key: str, order: tuple[str, ...], buckets: int) -> tuple[DataFrame, Window]:
    """The rows dealt by ranges of ``key``, and the window in which the row after each one, by
    descending key and ``order``, comes next; after the last row of all comes the first.

    The first rows of a range are also put behind the range before it, marked ``__extra``; so
    no range waits for another, and no task sees more than its own. Null keys come last.
    """
    low = -(1 << 63)
    ranked = frame.withColumn("__key", F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(low)))
    # Cut points: a bounded number of them, near equal shares of the rows apart.
    side = max(1, round(buckets**0.5))
    shares = [i / (side * side) for i in range(1, side * side)]
    cuts = ranked.agg(F.percentile_approx("__key", shares or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]

    def literal(values: list[int]) -> str:
        return "array(" + ", ".join(f"{v}L" if v > low else "-9223372036854775807L - 1L" for v in values) + ")" if values else "CAST(array() AS array<bigint>)"

    # Number of cuts below the key, looked up in two steps.
    tops = literal([g[-1] for g in groups[:-1] if g])
    group = f"size(filter({tops}, c -> c < __key))"
    nested = "array(" + ", ".join(literal(g) for g in groups) + ")"
    ranked = ranked.withColumn("__group", F.expr(group)).withColumn(
        "__bucket", F.expr(f"__group * {side} + size(filter(element_at({nested}, __group + 1), c -> c < __key))")
    )
    heads = {r["__bucket"]: r["head"] for r in ranked.groupBy("__bucket").agg(F.max("__key").alias("head")).collect()}
    filled = sorted(heads)  # at most a bucket a cut, and one
    target = {heads[b]: filled[(at + 1) % len(filled)] for at, b in enumerate(filled)}
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("extra"))
    behind = F.lit(None).cast("int")
    if target:
        behind = F.element_at(F.create_map(*[F.lit(x) for pair in target.items() for x in pair]), F.col("__key")).cast("int")
    both = F.when(behind.isNotNull(), F.array(own, F.struct(behind.alias("b"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    dealt = (
        ranked.withColumn("__at", F.explode(both))
        .withColumn("__bucket", F.col("__at.b")).withColumn("__extra", F.col("__at.extra"))
        .drop("__at", "__group")
    )
    window = Window.partitionBy("__bucket").orderBy(
        "__extra", F.col("__key").desc(), *[F.col(f"`{c}`").desc_nulls_last() for c in order]
    )
    return dealt, window


def op1_document_fingerprints(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and how like they are."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, window = with_next_row(documents, "doc_id", ("text",), 4 * partitions)
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(window)).withColumn("third", third)
    rows = rows.withColumn(
        "edited", F.concat(F.expr("left(text, length(text) - third)"), F.expr("left(next_text, third)"))
    )
    rows = with_fingerprint(with_fingerprint(rows, "text", "own"), "edited", "changed")
    rows = rows.withColumn("own_set", hashes_of(F.col("own"))).withColumn("next_set", F.lead("own_set").over(window))
    return rows.filter("NOT __extra").select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("own")).alias("fingerprint"),
        written_out(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), hashes_of(F.col("changed"))).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
