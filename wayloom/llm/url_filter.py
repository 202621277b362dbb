"""URL filter: a Bloom filter cascade that answers membership exactly over the corpus's keys.

Level 0 holds the listed keys. Keys of the corpus that it lets through without being listed go
into level 1, listed keys that level 1 lets through into level 2, and so on until nothing is
let through wrongly. A key's answer is given by the first level that doesn't hold it, so the
table of urls is judged by bit tests alone, without a join.

The key universe is complete: all rule keys and host words that the urls of the corpus hold.
Building needs joins over its distinct keys; each level is a bounded array of bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.tables import table, written

MAX_BITS = 1 << 24
MAX_LEVELS = 64

# The rules of the query, and the words that mark a host no rule judges.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED_HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam", "track")


@dataclass(frozen=True)
class Level:
    bits: tuple[int, ...]  # 64 bits a word
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        size = 64 * len(self.bits)
        words = F.lit(np.array(self.bits, dtype=np.int64))
        test = F.lit(True)
        for place in _places(key, self.seed, self.hashes, size):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            test = test & (F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return test


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for null-free keys of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for at in reversed(range(len(self.levels))):
            answer = F.when(self.levels[at].holds(key), answer).otherwise(at % 2 == 1)
        return answer if self.levels else F.lit(False)


def _places(key: Column, seed: int, hashes: int, size: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(size))
    step = F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(size))
    return [(first + at * step) % size for at in range(hashes)]


def _level(keys: DataFrame, count: int, seed: int, bits_per_key: float, max_bits: int) -> Level:
    size = 64 * math.ceil(max(count * bits_per_key, 64) / 64)
    if size > max_bits:
        raise ValueError(f"{count} keys need {size} bits; the limit is {max_bits}")
    hashes = max(1, round(bits_per_key * math.log(2)))
    places = keys.select(F.explode(F.array(*_places(F.col("key"), seed, hashes, size))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("bits")
    )
    bits = [0] * (size // 64)
    for row in words.collect():  # at most size / 64 rows
        bits[row["word"]] = row["bits"]
    return Level(tuple(bits), hashes, seed)


def build_cascade(
    universe: DataFrame, listed: DataFrame, *, bits_per_key: float = 10.0, max_bits: int = MAX_BITS
) -> Cascade:
    """Cascade for the listed keys that occur in ``universe``; both have a column ``key``.

    Null and repeated keys are left out. Listed keys outside the universe are no key anyone
    asks for. A level of more than ``max_bits`` bits is an error: cut the list by a hash of the
    key and build one cascade for each part.
    """
    keys = written(universe.select("key").filter("key IS NOT NULL").distinct(), "url-keys")
    wanted = listed.select("key").filter("key IS NOT NULL").distinct()
    inside = written(keys.join(wanted, "key", "left_semi"), "url-listed")
    other = keys.join(wanted, "key", "left_anti")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        count = inside.count()
        if not count:
            return Cascade(tuple(levels))
        levels.append(_level(inside, count, len(levels), bits_per_key, max_bits))
        passed = written(other.filter(levels[-1].holds(F.col("key"))), "url-passed")
        inside, other = passed, inside
    raise RuntimeError(f"no end after {MAX_LEVELS} levels")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All (host suffix, path prefix) keys a rule with such a path could be written as."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def word_keys(host: Column) -> Column:
    """The words of a host, marked so that no rule is written like them."""
    return F.transform(F.split(host, r"[^a-z0-9]+"), lambda w: F.concat(F.lit("word "), w))


def judge_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    rules: dict[str, str] = RULES,
    blocked_words: tuple[str, ...] = BLOCKED_HOST_WORDS,
) -> DataFrame:
    """All columns, and host, path, rule and verdict.

    The longest rule that fits decides; of equally long ones that with the longer host. Without
    a rule, a host with a blocked word is blocked. Null urls and those without ``://`` have an
    empty host and path and are allowed. Columns of these names give way. Rules are given by
    the caller and few; each is written ``host/path``.
    """
    spark = pages.sparkSession
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    lengths = sorted({len(rule) - rule.index("/") for rule in rules})
    parsed = pages.select(*[F.col(f"`{c}`") for c in names], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    host, path = F.col("host"), F.col("path")
    candidates = F.concat(rule_keys(host, path, lengths), word_keys(host))
    universe = parsed.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()
    universe = written(universe.select(F.explode(candidates).alias("key")).distinct(), "url-universe")
    lists = {
        verdict: [r for r, v in rules.items() if v == verdict]
        + [f"word {w}" for w in blocked_words if verdict == "block"]
        for verdict in ("block", "allow")
    }
    cascades = {
        verdict: build_cascade(universe, spark.createDataFrame([(k,) for k in keys], "key string"))
        for verdict, keys in lists.items()
    }

    def fitting(keys: Column, verdict: str) -> Column:
        found = F.filter(keys, cascades[verdict].holds)
        return F.transform(found, lambda k: F.struct(
            F.length(k).alias("size"), F.length(F.substring_index(k, "/", 1)).alias("of_host"), k.alias("key"), F.lit(verdict).alias("verdict")
        ))

    keys = rule_keys(host, path, lengths)
    fits = parsed.withColumn("__best", F.array_max(F.concat(fitting(keys, "block"), fitting(keys, "allow"))))
    worded = F.exists(word_keys(host), cascades["block"].holds)
    return fits.select(
        *[F.col(f"`{c}`") for c in names], "host", "path", F.col("__best.key").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.when(worded, "block").otherwise("allow")).alias("verdict"),
    )


def op2_url_filter(spark, sf_dir):
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _fits(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


ORACLE = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=len, reverse=True))} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())}
  WHEN len(list_intersect(regexp_extract_all(host, '[a-z0-9]+'), {list(BLOCKED_HOST_WORDS)})) > 0
  THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
