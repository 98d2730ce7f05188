"""URL verdicts: rules by host and path, and a Bloom filter cascade for listed hosts, in DataFrame functions only (operator 9).

Level 1 holds the listed keys. Keys of the universe that it lets through although they
are not listed go into level 2; listed keys that level 2 lets through go into level 3;
and so on, until no false positive is left. A key's verdict is that of the first level
that lacks it, so over the universe the answer is exact. Bits are arrays of 64-bit words
in shards by key hash, each shard of at most `SHARD_BITS` bits; as long as all of a level
fits `SCALAR_BITS`, it is read as one scalar value, beyond that by its shard number.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise

SHARD_BITS = 1 << 20
SCALAR_BITS = 1 << 26
#: Rules as (verdict, rule text); the host is what stands before the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Parts of host names that put a host on the list.
LISTED_PARTS = ("casino", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; a null url or one without "://" has both empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), "path": F.regexp_extract(text, _URL, 2)})


def rule_of(rules: tuple = RULES) -> Column:
    """The longest rule that fits host and path, as (size, rule, verdict); null if none fits."""
    found = []
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None)


class Level:
    """Bits of one level, and the test for them."""

    def __init__(self, keys: DataFrame, count: int, number: int, chance: float):
        self.number, self.probes = number, max(1, round(math.log2(1 / chance)))
        bits = max(64, math.ceil(count * math.log2(1 / chance) * 1.4427))
        self.shards = -(-bits // SHARD_BITS)
        self.words = -(-bits // (64 * self.shards))
        self.scalar = self.shards * self.words * 64 <= SCALAR_BITS
        spark = keys.sparkSession
        at = keys.select(self._shard().alias("shard"), F.explode(F.array(*[self._place(i) for i in range(self.probes)])).alias("p"))
        set_ = at.select("shard", F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))
        empty = spark.range(self.shards * self.words).select(F.expr(f"id div {self.words}").alias("shard"), F.expr(f"id % {self.words}").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = set_.unionByName(empty).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        rows = words.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
        self.rows = materialise(rows, f"level{number}")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(-self.number), F.col("key")), F.lit(self.shards).cast("long"))

    def _place(self, probe: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.number), F.lit(probe), F.col("key")), F.lit(64 * self.words).cast("long"))

    def test(self, keys: DataFrame, to: str) -> DataFrame:
        """Adds the boolean column `to`: whether the level may hold the column `key`."""
        if self.scalar:
            bits = self.rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "bits"))), lambda x: x["bits"]).alias("all")).scalar()
            own, rows = F.element_at(bits, (self._shard() + 1).cast("int")), keys
        else:
            own, rows = F.col("__bits"), keys.withColumn("__shard", self._shard()).join(self.rows.select(F.col("shard").alias("__shard"), F.col("bits").alias("__bits")), "__shard")
        held = reduce(Column.__and__, [F.getbit(F.element_at(own, (F.expr("1") + F.floor(self._place(i) / 64)).cast("int")), F.pmod(self._place(i), F.lit(64).cast("long")).cast("int")) == 1 for i in range(self.probes)])
        return rows.withColumn(to, held).drop("__bits", "__shard")


class Cascade:
    """Exact membership for all keys of `universe` (key, listed; one row each)."""

    def __init__(self, universe: DataFrame, chance: float = 1 / 16):
        self.levels: list[Level] = []
        sides = {True: universe.where("listed").select("key"), False: universe.where("not listed").select("key")}
        counts = {r.listed: r["count"] for r in universe.groupBy("listed").count().collect()}
        inside = True
        left, size = sides[True], counts.get(True, 0)
        while size:
            level = Level(left, size, len(self.levels) + 1, chance)
            self.levels.append(level)
            through = level.test(sides[not inside], "held").where("held").select("key")
            through = materialise(through, "through")
            sides[not inside] = through
            inside, left, size = not inside, through, through.count()

    def listed(self, rows: DataFrame, key: str, to: str) -> DataFrame:
        """Adds the boolean column `to` for the column `key`, by the levels alone."""
        rows = rows.withColumn("key", F.col(key))
        names = [f"__level{x.number}" for x in self.levels]
        for level, name in zip(self.levels, names, strict=True):
            rows = level.test(rows, name)
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(names))):
            verdict = F.when(~F.col(names[i]), F.lit(i % 2 == 1)).otherwise(verdict)
        return rows.withColumn(to, verdict).drop("key", *names)


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict: that of the longest fitting rule, else block for listed hosts.

    `listed` is the block list, a table with a column `key` (host, lower case); repeated
    and null keys and keys that no page has change nothing. Pages without a host are judged
    like any other: their host is the empty text. Rows that repeat a page_id stay separate
    rows. Keys and list meet once, to build the cascade; pages are judged by its levels.
    """
    rows = with_host_and_path(pages).select("page_id", "host", "path")
    keys = listed.select("key").distinct().withColumn("listed", F.lit(True))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    universe = materialise(hosts.join(keys, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "hosts")
    judged = Cascade(universe).listed(rows, "host", "listed").withColumn("r", rule_of(rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")


def listed_hosts(pages: DataFrame, parts: tuple = LISTED_PARTS) -> DataFrame:
    """(key): the block list of the query, hosts of pages that have one of `parts` between dots or dashes."""
    hosts = with_host_and_path(pages).select(F.col("host").alias("key")).distinct()
    return hosts.where(F.col("key").rlike(f"(^|[.-])({'|'.join(parts)})([.-]|$)"))


def op9_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, listed_hosts(pages))


OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
judged AS (
  SELECT *, regexp_matches(host, '(^|[.-])({'|'.join(LISTED_PARTS)})([.-]|$)') AS listed,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""
