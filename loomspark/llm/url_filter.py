"""URL filters by a cascade of Bloom filters, with DataFrame functions alone.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that level 1
wrongly accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until no
false positive is left. Since the key universe is every key that the corpus can ask for,
the answers are exact: a key is listed if the first level that rejects it has an even
number, or if none rejects it and the number of levels is odd. Judging a url is then a
narrow projection; there is no join.

Size: level 1 accepts about as many unlisted keys as there are listed ones (its rate is
``listed / universe``), so all levels together take some ``log2(universe / listed)`` bits a
listed key. The lists are arguments on the driver, which bounds what each plan carries.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty
path starts with no rule's ``/``; a url that no rule fits gets ``default``; a rule in both
lists is an error; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.tables import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class BloomLevel:
    """One Bloom filter: ``bits`` positions in 64-bit words, ``hashes`` probes by double hashing."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> BloomLevel:
        bits = max(64, math.ceil(keys * math.log(1 / rate) / math.log(2) ** 2))
        return cls(number, bits, max(1, round(bits / max(1, keys) * math.log(2))) if keys * 40 > bits else 12)

    def position(self, key: Column, probe: Column) -> Column:
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.bits))
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.number + 1)), F.lit(self.bits - 1)) + 1
        return F.pmod(first + probe * step, F.lit(self.bits))

    def probes(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.hashes - 1))

    def filled(self, keys: DataFrame) -> BloomLevel:
        """This filter with ``keys.key`` put in; at most ``bits / 64`` rows come to the driver."""
        places = keys.select(F.explode(F.transform(self.probes(), lambda i: self.position(F.col("key"), i))).alias("at"))
        words = places.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) AS int)))").alias("bits")
        )
        found = {r.word: r.bits for r in words.collect()}
        return BloomLevel(self.number, self.bits, self.hashes, tuple(found.get(i, 0) for i in range(-(-self.bits // 64))))

    def accepts(self, key: Column) -> Column:
        words = F.lit(list(self.words))

        def bit(i: Column) -> Column:
            at = self.position(key, i)
            return F.getbit(F.element_at(words, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

        return F.forall(self.probes(), bit)


@dataclass(frozen=True)
class BloomCascade:
    """Exact membership of ``listed`` for every key of the universe it was built over."""

    levels: tuple[BloomLevel, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, rate: float = 0.5) -> BloomCascade:
        """From one-column frames of ``key``; ``universe`` may repeat keys and hold listed ones."""
        listed = cut(listed.where("key IS NOT NULL").distinct())
        n = listed.count()
        if not n:
            return cls(())
        size = universe.agg(F.approx_count_distinct("key")).first()[0]
        first = BloomLevel.sized(1, n, min(rate, max(n, 1) / max(size, 2 * n))).filled(listed)
        accepted = universe.where(first.accepts(F.col("key"))).select("key", F.lit(False).alias("listed"))
        marked = accepted.union(listed.select("key", F.lit(True))).groupBy("key").agg(F.max("listed").alias("listed"))
        wrong = marked.where("NOT listed").select("key")
        levels, inside, outside = [first], listed, cut(wrong)
        while wrong_keys := outside.count():
            level = BloomLevel.sized(len(levels) + 1, wrong_keys, rate).filled(outside)
            levels.append(level)
            inside, outside = outside, cut(inside.where(level.accepts(F.col("key"))))
        return cls(tuple(levels))

    def contains(self, key: Column) -> Column:
        """Levels are asked in turn; the first that rejects decides."""
        last = F.lit(len(self.levels) % 2 == 1)
        steps = reversed(list(enumerate(self.levels)))
        return reduce(lambda rest, step: F.when(~step[1].accepts(key), F.lit(step[0] % 2 == 1)).otherwise(rest), steps, last)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a url; both empty if it is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """The keys by which any of ``rules`` could fit: host suffixes by path prefixes of the rules' lengths."""
    labels = sorted({rule.partition("/")[0].count(".") + 1 for rule in rules})
    lengths = sorted({len(rule) - len(rule.partition("/")[0]) for rule in rules})
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels
        for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def key_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    values = F.lit(keys) if keys else F.array().cast("array<string>")
    return spark.range(1, numPartitions=1).select(F.explode(values).alias("key"))


def judge_urls(pages: DataFrame, allow: list[str], block: list[str], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id``, ``url``).

    A rule is ``host/path``; it fits its host and all subdomains where the url's path starts
    with the rule's. The longest rule that fits decides.
    """
    if both := set(allow) & set(block):
        raise ValueError(f"rules in both lists: {sorted(both)}")
    spark, rules = pages.sparkSession, [*allow, *block]
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = candidate_keys(F.col("host"), F.col("path"), rules)
    rule_keys = key_table(spark, rules)
    listed = BloomCascade.build(rule_keys, parts.select(F.explode(asked).alias("key")))
    blocked = BloomCascade.build(key_table(spark, block), rule_keys)
    hits = F.filter(asked, listed.contains)
    longest = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    verdict = F.when(F.col("rule").isNull(), default).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return parts.withColumn("rule", longest).withColumn("verdict", verdict)
