"""URL verdicts by host and path rules, held in a Bloom filter cascade.

The keys of the rules are encoded by level 1. Level 2 encodes the keys of the corpus that level 1 takes for rules,
level 3 those rules that level 2 takes for such keys, and so on until a level takes nothing wrongly. A key of the
corpus is listed exactly if the first level that rejects it has an even number, or it passes all of an odd number
of levels: membership is exact for all keys of the corpus and needs no join.

All work is in DataFrame expressions. A filter is a binary literal; the cascade's size follows the listed keys,
not the corpus, because the first level's false-positive rate is set from the corpus's key count. More than PART_RULES
listed keys are dealt by their crc32 to several cascades, each over its part of the universe: a key asks one of them.

Edge cases: a null url, or one without "://", has an empty host and path and no rule; an empty path fits no rule;
repeated rows are judged alike; extra columns are ignored; an empty table or rule list gives no rules' verdicts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import written

#: Listed keys of one cascade, about; the bound on what one filter's literal holds and what the driver gets at once.
PART_RULES = 200_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z folded; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as bytes, their number, the hashes of each key, and a seed."""

    bits: bytes
    size: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether all bits of a key are set."""
        test = F.lit(True)
        for at in positions(key, self.size, self.hashes, self.seed):
            byte = F.ascii(F.decode(F.substring(F.lit(self.bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            test = test & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        return test


def positions(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(size)) for i in range(hashes)]


def bloom_level(keys: DataFrame, count: int, false_rate: float, seed: int) -> Level:
    """A filter of the column key. Only its set bits come to the driver: hashes for each key, of about PART_RULES at most."""
    size = max(64, math.ceil(count * -math.log(false_rate) / math.log(2) ** 2))
    size, hashes = -(-size // 8) * 8, max(1, round(-math.log2(false_rate)))
    bits = bytearray(size // 8)
    for (at,) in keys.select(F.explode(F.array(*positions(F.col("key"), size, hashes, seed))).alias("at")).distinct().collect():
        bits[at // 8] |= 1 << at % 8
    return Level(bytes(bits), size, hashes, seed)


def cascade(spark: SparkSession, listed: list[str], universe: DataFrame) -> list[Level]:
    """The levels that tell listed keys from all other keys of universe (a column key, repeats allowed)."""
    if not listed:
        return []
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, len(listed) * math.sqrt(0.5) / max(1, total))
    levels = [bloom_level(inside, len(listed), rate, 1)]
    wrong = universe.where(levels[0].holds(F.col("key"))).join(F.broadcast(inside), "key", "left_anti").distinct()
    outside = written(wrong, "cascade")  # about as many keys as are listed, by the first level's rate
    encode, other = outside, inside
    while count := encode.count():
        if len(levels) > 60:
            raise RuntimeError("the cascade does not end")
        levels.append(bloom_level(encode, count, 0.5, len(levels) + 1))
        encode, other = other.where(levels[-1].holds(F.col("key"))), encode
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Exact membership for keys of the universe and listed keys."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels), 0, -1):
        out = F.when(~levels[k - 1].holds(key), F.lit(k % 2 == 0)).otherwise(out)
    return out


def cascades(spark: SparkSession, listed: list[str], universe: DataFrame) -> list[list[Level]]:
    """One cascade for each part of the keys; their number follows the listed keys alone."""
    parts = max(1, math.ceil(len(set(listed)) / PART_RULES))
    if parts == 1:
        return [cascade(spark, listed, universe)]
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for key in set(listed):
        dealt[zlib.crc32(key.encode()) % parts].append(key)
    return [cascade(spark, own, universe.where(_part(F.col("key"), parts) == p)) for p, own in enumerate(dealt)]


def _part(key: Column, parts: int) -> Column:
    return F.crc32(key.cast("binary")) % parts


def member_of_any(made: list[list[Level]], key: Column) -> Column:
    """Exact membership by the cascade that a key is dealt to."""
    out = member(made[0], key)
    for p in range(1, len(made)):
        out = F.when(_part(key, len(made)) == p, member(made[p], key)).otherwise(out)
    return out


def _shapes(rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """The (labels of the host, length of the path) that rules have."""
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape the one key that could fit a url, null where the url is too short for it."""
    labels = F.size(F.split(host, r"\."))
    return [
        F.when((labels >= n) & (F.length(path) >= length), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length)))
        for n, length in shapes
    ]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every url. rules: (allow or block, host, path); the longest that fits wins.

    A url that no rule fits is allowed, for it is not listed.
    """
    spark, shapes = pages.sparkSession, _shapes(rules)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    every = [host + path for _, host, path in rules]
    blocked = [host + path for verdict, host, path in rules if verdict == BLOCK]
    universe = rows.select(F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL") if keys else spark.createDataFrame([], "key string")
    own = spark.createDataFrame([(k,) for k in every], "key string")
    listed, block = cascades(spark, every, universe), cascades(spark, blocked, universe.union(own))
    found = [F.when(k.isNotNull() & member_of_any(listed, k), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in keys]
    best = F.array_max(F.array(*found))["key"] if found else F.lit(None).cast("string")
    out = rows.select("id", "host", "path", best.alias("rule"))
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull() & member_of_any(block, F.col("rule")), BLOCK).otherwise(ALLOW))
