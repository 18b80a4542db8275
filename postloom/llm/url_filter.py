"""URL filters: host and path rules, and exact list membership by a cascade of Bloom filters.

The block list is a table of domains; a host is listed if it or a domain above it is.  The keys are hosts, and
the corpus's complete universe of keys is that of all rows' hosts; which of them are listed is found once,
over distinct hosts.  The cascade is built over that universe.  Level 1 encodes the listed keys;
level 2 those unlisted keys that level 1 lets through by mistake; level 3 the listed keys that level 2
lets through, and so on until no mistake is left.  A key of the universe is then listed exactly if the
first level that it misses is even, or if it passes them all and the last is odd.  Judging a row is a
probe of a few words, without a join.

Filters are built by the tasks as (word, bits) rows that Spark merges with bit_or; only filters of a
bounded size come to the driver.  A universe whose filters would be larger is split into shards by the
keys' hash; the rows are then written once by shard, and each shard's filters judge its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: The largest filter of a shard, in bits (16 MB).
SHARD_BITS = 1 << 27
MOST_LEVELS = 60


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str  # with its leading slash

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
class Level(NamedTuple):
    words: np.ndarray
    bits: int
    hashes: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for a null url or one without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, upper, lower), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    salt = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for k in range(hashes):
        x = (h1 + np.uint64(k) * (h2 | np.uint64(1))) * salt
        yield (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def passes(level: int, x: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for place in _places(h1, h2, level, x.bits, x.hashes):
        out &= (x.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For keys of the universe: whether they are listed."""
    out, going = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, level in enumerate(levels):
        through = passes(k, level, h1[going], h2[going])
        out[going[~through]] = k % 2 == 1
        going = going[through]
    out[going] = len(levels) % 2 == 1
    return out


def bloom_filter(keys: DataFrame, level: int, n: int, wrong: float) -> Level:
    """The Bloom filter of n keys with a share of wrong answers."""
    bits = max(64, -(-math.ceil(n * math.log(1 / wrong) / math.log(2) ** 2) // 64) * 64)
    hashes = max(1, round(bits / n * math.log(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)  # one task's share of the filter, merged before it is sent
        for batch in batches:
            for place in _places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), level, bits, hashes):
                np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), place & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "value"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return Level(words, bits, hashes)


def build_cascade(keys: DataFrame) -> list[Level]:
    """The levels for distinct keys (h1, h2, is_listed); no level if none is listed."""
    spark = keys.sparkSession
    sets = [keys.where("is_listed"), keys.where("not is_listed")]
    sizes = [x.count() for x in sets]
    levels: list[Level] = []
    while sizes[0]:
        k = len(levels)
        if k == MOST_LEVELS:
            raise ValueError("listed and unlisted keys share their hashes")
        wrong = 0.5 if k else min(0.5, max(1e-6, sizes[0] * 0.5**0.5 / max(sizes[1], 1)))
        levels.append(bloom_filter(sets[0], k, sizes[0], wrong))
        shared = spark.sparkContext.broadcast((k, levels[-1]))

        def through(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(*shared.value, _unsigned(batch.column(0)), _unsigned(batch.column(1)))))

        mistakes = materialize(sets[1].select("h1", "h2").mapInArrow(through, "h1 long, h2 long"), "mistakes")
        sets, sizes = [mistakes, sets[0]], [mistakes.count(), sizes[0]]
    return levels


def _domains(host: str) -> Column:
    """A host's domains, the whole host first."""
    labels = f"split({host}, '[.]')"
    return F.expr(f"transform(sequence(1, size({labels})), k -> array_join(slice({labels}, k, size({labels})), '.'))")


def judge(pages: DataFrame, block_list: DataFrame, id_col: str = "page_id", url_col: str = "url", domain_col: str = "domain", rules: tuple[Rule, ...] = RULES, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    ``block_list`` is a table of domains; null ones list nothing, repeated ones and capitals do no harm.  Where no
    rule fits, a host on the list, or below a domain on it, is blocked, any other allowed.  A null url has an empty
    host and path; the empty host is a key as any other.  Null and repeated ids are kept; other columns are ignored.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"h1": F.xxhash64("host"), "h2": F.xxhash64(F.lit(1), "host")})
    universe = materialize(rows.select("host", "h1", "h2").distinct(), "universe")
    domains = block_list.select(F.lower(F.col(domain_col).cast("string")).alias("key")).where("key is not null").distinct()
    hit = universe.select("host", F.explode(_domains("host")).alias("key")).join(domains, "key").select("host").distinct().withColumn("is_listed", F.lit(True))
    keys = materialize(universe.join(hit, "host", "left").select("h1", "h2", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), "keys")
    shards = max(1, math.ceil(keys.where("is_listed").count() * 30 / shard_bits))  # 30 bits a key at the least share of mistakes
    shard = F.pmod("h1", F.lit(shards))
    if shards > 1:
        rows = materialize(rows.withColumn("shard", shard), "sharded", "shard")
    judged = None
    for k in range(shards):
        levels = spark.sparkContext.broadcast(build_cascade(keys.where(shard == k)))

        def probe(batches: Iterator[pa.RecordBatch], levels=levels) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = listed(levels.value, _unsigned(batch.column("h1")), _unsigned(batch.column("h2")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["page_id", "host", "path", "is_listed"])

        part = (rows.where(F.col("shard") == k).drop("shard") if shards > 1 else rows).mapInArrow(probe, f"page_id {kind}, host string, path string, is_listed boolean")
        judged = part if judged is None else judged.unionByName(part)
    ruled = judged.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r as (select *, '.' || host as dotted from p),
f as (select page_id, host, path, case
  when suffix(dotted, '.example.com') and prefix(path, '/de/') then 'example.com/de/'
  when suffix(dotted, '.example.net') and prefix(path, '/en/') then 'example.net/en/'
  when suffix(dotted, '.org') and prefix(path, '/fr/') then 'org/fr/'
  when suffix(dotted, '.net') and prefix(path, '/') then 'net/' end as rule from r)
select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
  else case when list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'ads-track', 'casino-win', 'adult-x', 'free-bets']) then 'block' else 'allow' end end as verdict from f
"""
