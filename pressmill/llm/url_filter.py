"""Exact membership in a list by a cascade of Bloom filters, and URL rules, in built-in expressions.

The first level encodes the listed keys. The second encodes those other keys of
the corpus that the first takes for listed, the third those listed keys that the
second takes for such, and so on until a level has nothing to encode. The first
level that doesn't know a key decides; so every listed key and every key of the
corpus is told right, and judging a row is a few bit tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import ascii_lower, frozen

FIRST_RATE = 0.01
NEXT_RATE = 0.5
MOST_BITS = 1 << 26
WORD = 64

#: Domains that link and pill farms of the corpus live on; a parameter of the query.
BLOCKED_DOMAINS = [
    "ads-track.example.com",
    "adult-x.example.com",
    "casino-win.example.net",
    "cheap-pills.example.com",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
]


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def domain(name: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host, or all it has."""
    return F.substring_index(name, ".", -labels)


def _tests(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """The places a key has at a level."""
    return [F.pmod(F.xxhash64(key, F.lit(64 * level + at)), F.lit(bits).cast("long")) for at in range(hashes)]


class Cascade:
    """Levels of (table with one array of words, number of bits, number of hashes)."""

    def __init__(self, levels: list[tuple[DataFrame, int, int]]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        """Whether a key is listed; NULL is not. The words are read once per query, as a scalar."""
        found = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            found = F.when(self.known(key, number), found).otherwise(F.lit(number % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(found)

    def known(self, key: Column, number: int) -> Column:
        """Whether the filter of one level takes a key for its own."""
        table, bits, hashes = self.levels[number]
        words = table.scalar()
        found = F.lit(True)
        for place in _tests(key, number, bits, hashes):
            word = F.get(words, F.floor(place / WORD).cast("int"))
            found = found & (F.getbit(word, (place % WORD).cast("int")) == 1)
        return found


def _filter(keys: DataFrame, level: int, count: int, rate: float) -> tuple[DataFrame, int, int]:
    """A Bloom filter of ``count`` keys as one row with an array of 64-bit words."""
    bits = max(WORD, -(-math.ceil(count * math.log2(1 / rate) / math.log(2)) // WORD) * WORD)
    hashes = max(1, round(math.log2(1 / rate)))
    places = keys.select(F.explode(F.array(*_tests(F.col("key"), level, bits, hashes))).alias("place"))
    set_bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = places.groupBy(F.floor(F.col("place") / WORD).alias("word")).agg(F.bit_or(set_bit).alias("bits"))
    every = keys.sparkSession.range(bits // WORD).withColumnRenamed("id", "word").join(words, "word", "left")
    lined = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    row = every.agg(F.transform(lined, lambda one: one["bits"]).alias("words"))
    return frozen(row), bits, hashes


def build(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """A cascade for the ``key`` column of ``listed``, exact for these and all keys of ``universe``.

    NULL and repeated keys count for nothing. The first level takes about 10 bits
    a listed key, later ones 1.5 bits a wrong key; None is given back where a
    level would take more than ``most_bits``, for then the list is to be joined.
    """
    own = frozen(listed.select(F.col("key").cast("string")).filter("key is not null").distinct())
    other = frozen(universe.select(F.col("key").cast("string")).filter("key is not null").distinct().join(own, "key", "left_anti"))
    counts = [own.count(), other.count()]
    rate = min(FIRST_RATE, counts[0] / max(1, counts[1])) or FIRST_RATE
    sides, levels = [own, other], []
    while counts[len(levels) % 2]:
        number = len(levels)
        if counts[number % 2] * math.log2(1 / (NEXT_RATE if number else rate)) / math.log(2) > most_bits:
            return None
        levels.append(_filter(sides[number % 2], number, counts[number % 2], NEXT_RATE if number else rate))
        wrong = (number + 1) % 2
        sides[wrong] = frozen(sides[wrong].filter(Cascade(levels).known(F.col("key"), number)))
        counts[wrong] = sides[wrong].count()
    return Cascade(levels)


def fitting_rule(name: Column, at: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the (verdict, host, path) rules that fits, as a struct of rule and verdict; else NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda rule: (len(rule[1] + rule[2]), rule)):
        fits = ((name == rule_host) | name.endswith(f".{rule_host}")) & at.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_pages(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], most_bits: int = MOST_BITS) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``.

    ``pages`` needs ``page_id`` and ``url``, ``listed`` a column ``key`` of domains;
    other columns are ignored. Where no rule fits, a page is blocked if its host
    or a domain above it is listed. A NULL url or one without ``://`` has an
    empty host and path and is allowed; of rules of equal length the last in
    order wins. Repeated rows come out as often as they went in.

    A name with more labels than any listed one can't be listed, so a host's ends
    are looked up as far as the list goes. A list beyond ``most_bits`` is joined
    to the distinct hosts instead.
    """
    address = F.col("url").cast("string")
    listed = listed.filter("key <> ''")
    depth = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("depth")).first()["depth"] or 0
    hosts = frozen(pages.select(host(address).alias("host")).distinct())
    ends = F.array(*[domain(F.col("host"), labels) for labels in range(1, depth + 1)]).cast("array<string>")
    keys = hosts.select("host", F.explode(ends).alias("key"))
    cascade = build(listed, keys, most_bits)
    parsed = pages.select("page_id", host(address).alias("host"), path(address).alias("path"))
    if cascade:
        bad = F.lit(False)
        for labels in range(1, depth + 1):
            bad = bad | cascade.holds(domain(F.col("host"), labels))
        parsed = parsed.withColumn("bad", bad)
    else:
        own = listed.select(F.col("key").cast("string")).distinct()
        bad = keys.join(own, "key", "left_semi").select("host", F.lit(True).alias("bad")).distinct()
        parsed = parsed.join(bad, "host", "left")
    ruled = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    other = F.when(F.col("bad"), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", other).alias("verdict"))
