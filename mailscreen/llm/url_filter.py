"""URL filter: exact membership of hosts in a block list through a cascade of Bloom filters.

The keys of a URL are its host and every parent domain.  The universe is the set of all
keys of the corpus; the listed keys in it are known, so is everything else.  Level 1 is a
Bloom filter of the listed keys, level 2 one of the unlisted keys that level 1 lets
through, level 3 one of the listed keys that level 2 lets through, and so on until nothing
is left over.  A key is listed if the first level that refuses it has an even number (or
none refuses it and the number of levels is odd).  For keys of the universe that is exact.

Lookups are Column expressions over literal bit arrays: no join, no shuffle of pages.  The
arrays take about 1.44 log2(1/p) bits per key: they grow with the listed keys that occur
in the corpus, not with its pages.  Bits are set by a grouped `bit_or`; the driver only
gets the words of the finished filters, of at most `max_filter_bytes` together (an error
beyond that: split the list).

Edge cases: a null URL or one without "://" has an empty host and path and is allowed by
the method; listed keys that are null or empty are ignored; an empty list or table blocks
nothing; rows are answered one by one, so repeated rows and ties need nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.registry import long_array
from mailscreen.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."))
    return F.filter(parents, lambda k: k != "")


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = rule.fits(host, path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class BloomLevel:
    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def may_hold(self, key: Column) -> Column:
        words = long_array(self.words)
        places = F.array(*bit_positions(key, self.bits, self.hashes, self.salt))
        return F.forall(places, lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)


def bit_positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Double hashing: h1 + i * h2 over `bits` places."""
    first, second = F.xxhash64(key, F.lit(2 * salt)), F.xxhash64(key, F.lit(2 * salt + 1))
    return [F.pmod(F.pmod(first, F.lit(bits)) + F.lit(i) * F.pmod(second, F.lit(bits)), F.lit(bits)) for i in range(hashes)]


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> BloomLevel:
    """A Bloom filter over the `key` column of `count` keys with about `rate` false positives."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * 1.4427 * math.log2(1 / rate) / 64) * 64)
    places = keys.select(F.explode(F.array(*bit_positions(F.col("key"), bits, hashes, salt))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("set"))
    array = [0] * (bits // 64)
    for row in words.collect():
        array[row["word"]] = row["set"]
    return BloomLevel(bits, hashes, salt, tuple(array))


class Cascade:
    """The levels, and the membership test they make up."""

    def __init__(self, levels: list[BloomLevel]) -> None:
        self.levels = levels

    def lists(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for number, level in reversed(list(enumerate(self.levels, 1))):
            listed = F.when(~level.may_hold(key), F.lit(number % 2 == 0)).otherwise(listed)
        return listed


def build_cascade(universe: DataFrame, listed: DataFrame, first_rate: float = 0.02, rate: float = 0.5, max_filter_bytes: int = 64 << 20) -> Cascade:
    """A cascade that is exact for every key of `universe` (both have a column `key`).

    `listed` keys outside the universe are left out: nobody will ask for them.
    """
    all_keys = universe.where("key <> ''").select("key").distinct()
    marks = listed.where("key <> ''").select("key").distinct().withColumn("_listed", F.lit(True))
    keys = settle(all_keys.join(marks, "key", "left").select("key", F.coalesce("_listed", F.lit(False)).alias("listed")))
    levels: list[BloomLevel] = []
    rest = {True: keys.where("listed"), False: keys.where("NOT listed")}
    while True:
        side = len(levels) % 2 == 0
        count = rest[side].count()
        if count == 0:
            return Cascade(levels)
        levels.append(build_level(rest[side], count, rate if levels else first_rate, len(levels)))
        if 8 * sum(len(x.words) for x in levels) > max_filter_bytes:
            raise ValueError(f"the filters take more than {max_filter_bytes} bytes; split the list")
        rest[not side] = settle(rest[not side].where(levels[-1].may_hold(F.col("key"))))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, listed, verdict: the longest rule's, else block for a listed host."""
    kept = pages.drop("host", "path", "rule", "listed", "verdict")
    hosts = kept.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    universe = hosts.select(F.explode(host_keys(F.col("host"))).alias("key"))
    cascade = build_cascade(universe, listed)
    rule, decided = longest_rule(rules, F.col("host"), F.col("path"))
    member = F.exists(host_keys(F.col("host")), cascade.lists)
    judged = hosts.withColumns({"rule": rule, "listed": member})
    return judged.withColumn("verdict", F.coalesce(decided, F.when(F.col("listed"), "block").otherwise("allow")))
