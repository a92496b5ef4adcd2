"""URL filters: a Bloom filter cascade over a complete key universe, and host/path rules.

A cascade encodes which keys of a known universe are listed. Level 1 is a Bloom filter of the
listed keys; level 2 holds the unlisted keys that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until no key passes by mistake. Every key of the universe is
then decided exactly, by hashing alone.

Nulls: a null url, or one without ``://``, has an empty host and path. Empty hosts are keys like
any other. Repeated urls and hosts count once in the cascade; rows are never dropped. An empty
list needs no level and lists nothing. Other columns of the input are not read.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.llm.support import lower_ascii
from matchlane.session import materialise, work_path

PAGE_BITS = 32768
LITERAL_BYTES = 4 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.name)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions, ``probes`` hashes a key."""

    seed: int
    bits: int
    probes: int
    data: bytes

    def position(self, key: Column, probe: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), probe), F.lit(self.bits))

    def holds(self, key: Column) -> Column:
        data, found = F.lit(self.data), F.lit(True)
        for probe in range(self.probes):
            at = self.position(key, F.lit(probe))
            byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
            bit = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (at % 8 + 1).cast("int")))
            found = found & (bit != 0)
        return found


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys``; its pages are built by partial aggregation."""
    probes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    empty = Level(seed, bits, probes, b"")
    at = empty.position(F.col("key"), F.col("probe")) + 1
    pages = (
        keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("probe"))
        .select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )
    data = bytearray(math.ceil(bits / PAGE_BITS) * (PAGE_BITS // 8))
    for page, bitmap in pages.toLocalIterator():
        data[(page - 1) * PAGE_BITS // 8 : page * PAGE_BITS // 8] = bitmap
    return Level(seed, bits, probes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Whether ``key``, one of the universe, is listed."""
        key = F.coalesce(key, F.lit(""))
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[depth].holds(key), verdict).otherwise(F.lit(depth % 2 == 1))
        return verdict


def cascade_bytes(listed: int, others: int) -> float:
    """Expected size: the first level at its rate, the others at one half."""
    rate = _first_rate(listed, others)
    return (listed * math.log2(1 / rate) + 3 * listed) / math.log(2) / 8


def _first_rate(listed: int, others: int) -> float:
    return min(0.5, max(1e-9, math.sqrt(0.5) * listed / max(1, others)))


def build_cascade(keys: DataFrame) -> Cascade:
    """``keys``: one row per key of the universe (key, listed); a stored table, as it is read once a level."""
    counts = {row.listed: row["count"] for row in keys.groupBy("listed").count().collect()}
    n, others = counts.get(True, 0), counts.get(False, 0)
    sides = [keys.where("listed").select("key"), keys.where("not listed").select("key")]
    levels: list[Level] = []
    while n:
        rate = _first_rate(n, others) if not levels else 0.5
        level = _level(sides[0], n, rate, len(levels) + 1)
        levels.append(level)
        passed = sides[1].where(level.holds(F.col("key")))
        sides = [passed, sides[0]]
        n = passed.count()
    return Cascade(levels)


def is_listed(df: DataFrame, key: Column, keys: DataFrame, max_bytes: int = LITERAL_BYTES) -> DataFrame:
    """``df`` with a boolean column ``listed``.

    The cascade travels with the plan, so its size is worked out first; a list whose cascade would
    exceed ``max_bytes`` (one page of a filter at least) is cut into shards by the hash of the key, each
    with a cascade of its own.
    """
    counts = {row.listed: row["count"] for row in keys.groupBy("listed").count().collect()}
    shards = math.ceil(cascade_bytes(counts.get(True, 0), counts.get(False, 0)) / max(max_bytes, PAGE_BITS // 8))
    if shards <= 1:
        return df.withColumn("listed", build_cascade(keys).listed(key))
    return _listed_by_shard(df, key, keys, shards)


def _listed_by_shard(df: DataFrame, key: Column, keys: DataFrame, shards: int) -> DataFrame:
    """``df`` with ``listed``, stored: one shard's cascade after the other decides the rows of its keys.

    Rows and keys are written once, by shard and without a shuffle, so that each is read once more. A
    shard with a frequent key holds more files, not larger ones.
    """
    held = df.select(F.struct("*").alias("row"), F.coalesce(key, F.lit("")).alias("key"))
    rows, universe = (_by_shard(x, shards, name) for x, name in ((held, "url-rows"), (keys, "url-shards")))
    path = work_path(df.sparkSession, "url-listed")
    for shard in range(shards):
        cascade = build_cascade(universe.where(F.col("shard") == shard))
        judged = rows.where(F.col("shard") == shard).select("row.*", cascade.listed(F.col("key")).alias("listed"))
        judged.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.withColumn("listed", F.lit(True)).schema).parquet(path)


def _by_shard(df: DataFrame, shards: int, name: str) -> DataFrame:
    """``df`` as a stored table in folders by ``shard``, a hash of its ``key``."""
    path = work_path(df.sparkSession, name)
    dealt = df.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)))
    dealt.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def key_universe(hosts: DataFrame, listed: Column) -> DataFrame:
    """All distinct keys of ``hosts.host`` with ``listed``, as a stored table."""
    distinct = hosts.select(F.coalesce("host", F.lit("")).alias("key")).distinct()
    return materialise(distinct.select("key", F.coalesce(listed, F.lit(False)).alias("listed")), "url-keys")


def judge_urls(pages: DataFrame, rules: list[Rule], listed: Column, max_bytes: int = LITERAL_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed`` is an expression over ``key``, the host: whether the block list holds it. A rule's
    verdict wins; else a listed host is blocked and any other allowed.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = key_universe(parts, listed)
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = is_listed(parts, F.col("host"), keys, max_bytes)
    return judged.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
