"""URL filters by Bloom filter cascades: exact membership in lists of keys, without a join at lookup.

A cascade's first filter holds the listed keys, the second the keys of the corpus that pass the first by mistake, the third
the listed keys that pass the second by mistake, and so on until no mistake is left.  The first filter that rejects a key
tells its side.  Mistakes are looked for among all keys of the corpus, so the answer is exact for every url judged.

The first filter lets through about as many foreign keys as there are listed ones, so its size is that of the list times the
logarithm of the corpus, and later filters shrink.  Lists whose cascade would pass ``max_bits`` are joined instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# hosts of unwanted pages; a list of your own can be passed
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
MAX_BITS = 1 << 26  # 8 MB of filters in a plan, about 2 million listed keys
MAX_SHAPES = 4096


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Level:
    """One filter: its words in order, its bits, and its hash functions."""

    def __init__(self, keys: DataFrame, count: int, miss: float, seed: int):
        self.hashes = max(1, round(-log2(miss)))
        self.bits = 64 * max(1, ceil(count * self.hashes / log(2) / 64))
        self.seed = seed
        set_bits = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("p"))
        words = set_bits.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        table = [0] * (self.bits // 64)
        for row in words.collect():  # at most bits / 64 rows, and the bits are bounded by the list
            table[row["w"]] = row["bits"]
        self.words = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def _places(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * self.seed + i)), F.lit(self.bits)) for i in (0, 1))
        return [F.pmod(a + b * j, F.lit(self.bits)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        tests = [F.getbit(F.get(self.words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self._places(key)]
        out = tests[0]
        for test in tests[1:]:
            out &= test
        return out


class Cascade:
    """Membership of the listed keys (column ``key``), exact for every key of ``universe`` (column ``key``) and every listed one.

    ``size`` bounds the number of distinct keys of the universe from above.  Null keys are in no list.  An empty list holds nothing.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, size: int, scratch: Scratch):
        listed = scratch.stage(listed.where("key IS NOT NULL").select("key").distinct())
        self.count = listed.count()
        self.levels: list[Level] = []
        if not self.count:
            return
        self.levels.append(Level(listed, self.count, min(0.5, 0.7 * self.count / max(1, size)), 0))
        strays = universe.select("key").where(self.levels[0].passes(F.col("key")))
        sides = scratch.stage(listed.withColumn("side", F.lit(1)).unionByName(strays.withColumn("side", F.lit(0)))
                              .groupBy("key").agg(F.max("side").alias("side")))
        inside = 0  # the side that the next filter holds
        while left := sides.where(F.col("side") == inside).where(self._seen()).count():
            if len(self.levels) > 200:
                raise RuntimeError("the cascade does not shrink")
            held = sides.where(F.col("side") == inside).where(self._seen())
            self.levels.append(Level(held, left, 0.5, len(self.levels)))
            inside = 1 - inside

    def _seen(self) -> Column:
        """Passed all filters so far."""
        out = F.lit(True)
        for level in self.levels:
            out &= level.passes(F.col("key"))
        return out

    def holds(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return F.coalesce(out, F.lit(False))


def bits_needed(count: int, size: int) -> float:
    return count * (max(1.0, log2(max(1, size) / (0.7 * count))) + 4) / log(2) if count else 0


def _shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of the host, code points of the path) of the listed keys; these bound the keys of one url."""
    found = keys.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(found) > MAX_SHAPES:
        raise ValueError(f"listed keys of more than {MAX_SHAPES} different shapes")
    return sorted((r["labels"], r["chars"]) for r in found)


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Of every shape that the url has, the key: so many last labels of the host, so many first code points of the path."""
    table = F.from_json(F.lit(json.dumps([{"l": a, "c": b} for a, b in shapes])), "array<struct<l:int,c:int>>")
    labels = F.split(host, r"\.")
    fits = F.filter(table, lambda s: (s["l"] <= F.size(labels)) & (s["c"] <= F.length(path)))

    def key(s: Column) -> Column:
        suffix = F.array_join(F.slice(labels, F.size(labels) - s["l"] + 1, s["l"]), ".")
        text = F.concat(suffix, F.substring(path, F.lit(1), s["c"]))
        return F.struct(F.length(text).alias("length"), F.length(suffix).alias("host_length"), text.alias("key"))

    return F.transform(fits, key)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, listed: Iterable[str] | DataFrame = LISTED,
               url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits; ties: the longer host) and ``verdict``.

    ``rules`` are (host, path, allow or block); a rule fits its host and all subdomains if the path starts with the rule's.
    Without a fitting rule a url is blocked if its host, or a domain above it, is in ``listed``.  A null url, one without
    ``://`` and an empty one have an empty host and path, fit no rule and are allowed.  Every row gives one row, repeated
    ones too; columns of ``pages`` named like an output are replaced; an empty table gives no rows.  A rule listed with both
    verdicts is refused.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(h,) for h in listed], "host string")
    scratch = Scratch(spark)
    rules = scratch.stage(rules.select("host", "path", "verdict", F.concat("host", "path").alias("key")).distinct())
    if rules.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("a rule with more than one verdict")
    listed = listed.select("host", F.lit("").alias("path"), F.col("host").alias("key"))
    text = text_of(url)
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(text), "path": path_of(text)})
    rows, blocked = pages.count(), rules.where("verdict = 'block'")
    by_rule, by_host = (_candidates(F.col("host"), F.col("path"), _shapes(keys)) for keys in (rules, listed))
    sizes = {"rule": rows * len(_shapes(rules)), "host": rows * len(_shapes(listed))}
    if max(bits_needed(rules.count(), sizes["rule"]), bits_needed(listed.count(), sizes["host"])) > max_bits:
        return _judge_by_joins(base, rules, listed, by_rule, by_host)
    in_rules = Cascade(rules, base.select(F.explode(by_rule).alias("k")).select("k.key"), sizes["rule"], scratch)
    in_listed = Cascade(listed, base.select(F.explode(by_host).alias("k")).select("k.key"), sizes["host"], scratch)
    blocks = Cascade(blocked, rules, in_rules.count, scratch)
    out = base.withColumn("rule", F.array_max(F.filter(by_rule, lambda k: in_rules.holds(k["key"])))["key"])
    ruled = F.when(blocks.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    other = F.when(F.exists(by_host, lambda k: in_listed.holds(k["key"])), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), ruled).otherwise(other))


def _judge_by_joins(base: DataFrame, rules: DataFrame, listed: DataFrame, by_rule: Column, by_host: Column) -> DataFrame:
    """The same verdicts by equi joins on the distinct hosts and paths, for lists too large for a plan."""
    urls = base.select("host", "path").distinct()
    keys = urls.select("host", "path", F.explode(by_rule).alias("k")).withColumn("key", F.col("k.key"))
    best = keys.join(rules.select("key", "verdict"), "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), "k").alias("best"))
    hosts = urls.select("host", F.lit("").alias("path")).distinct().select("host", F.explode(by_host).alias("k")).select("host", "k.key")
    flagged = hosts.join(listed.select("key").distinct(), "key", "left_semi").select("host", F.lit(True).alias("_flagged")).distinct()
    judged = urls.join(best, ["host", "path"], "left").join(flagged, "host", "left").select(
        "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.when(F.col("_flagged"), "block"), F.lit("allow")).alias("verdict"))
    return base.join(judged, ["host", "path"], "left")
