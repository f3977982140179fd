"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

A rule is a host and the start of a path; it fits its host and all subdomains. The keys of a URL are the strings
(last d labels of its host) + (first n characters of its path) for each pair (d, n) that some rule has, so a rule fits
exactly if its own string is among them. The cascade tells listed keys from all other keys of the corpus: level 0 is a
Bloom filter of the listed keys, level 1 of the corpus's keys that level 0 takes for listed, level 2 of the listed keys
that level 1 takes for those, and so on until a level errs nowhere. A lookup walks down until a level says no: an odd
level's no means listed, an even level's no means not. This is exact for every key of the universe that the cascade
was built over, so pages are judged without a join or a shuffle. A second cascade, over the listed keys alone, tells
rules that block from rules that allow.

Build: one pass estimates the number of distinct keys, one gathers those that level 0 lets through; its error rate is
chosen by the two counts so that these are fewer than the listed keys, and each level below halves them. Filters are
set by an aggregate over 64-bit words; only their bits come to the driver. Their size goes with the list, not with the
corpus: about 1.5 log2(keys / listed) + 5 bits a listed key. Where that exceeds `max_bytes`, listed keys are cut by
hash into segments with a cascade each and pages are judged in one pass a segment, each written to shared storage.

Of the rules that fit, the longest string wins, of equal ones that with more labels. A rule listed both ways blocks.
Where none fits, the verdict is `default` (allow): a key that is not listed is not filtered. Nulls: a null URL and one
without `://` have empty host and path and no rule. Empty hosts have no rule. Repeated pages are judged alike; rows
with null page_id as others. Without rules or pages the result is as defined by these rules. Other columns are not
read, whatever their names. A long URL costs its length for each pair (d, n).
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import discard, load, materialize

#: The rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MAX_BYTES = 256 << 20
MOST_LEVELS = 64
#: More than there are shapes; a score is (size, shape), and shapes are sorted by labels.
_SHAPES = 1 << 20


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL; both empty without ://."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("key", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


@dataclass
class Level:
    """A Bloom filter: `size` bits in 64-bit words, `probes` places a key, hashes rotated by `turn` bits."""

    size: int
    probes: int
    turn: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        def part(h):
            u = h.view(np.uint64)
            u = u << np.uint64(self.turn) | u >> np.uint64(64 - self.turn) if self.turn else u
            return (u.view(np.int64) % self.size).astype(np.int64)

        a, b = part(h1), part(h2)
        found = np.ones(len(a), bool)
        for i in range(self.probes):
            at = (a + i * b) % self.size
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)
    segment: int = 0
    segments: int = 1

    @property
    def n_bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys are listed: exact for the universe."""
        out = np.zeros(len(h1), bool)
        left = np.flatnonzero((h1 ^ h2) % self.segments == self.segment) if self.segments > 1 else np.arange(len(h1))
        for i, level in enumerate(self.levels):
            held = level.holds(h1[left], h2[left])
            if i % 2:
                out[left[~held]] = True
            left = left[held]
        if len(self.levels) % 2:
            out[left] = True
        return out


def _level(keys: DataFrame, n: int, rate: float, turn: int) -> Level:
    """A filter of the n rows of keys (h1, h2) with that error rate."""
    size = max(63, math.ceil(n * math.log2(1 / rate) / math.log(2))) | 1
    probes = max(1, round(size / max(n, 1) * math.log(2))) if n else 1
    probes = min(probes, 40)

    def part(name: str) -> Column:
        h = F.col(name)
        h = F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h
        return F.pmod(h, F.lit(size).cast("long"))

    places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(probes - 1).cast("long")), lambda i: F.pmod(F.col("a") + i * F.col("b"), F.lit(size).cast("long")))
    at = keys.select(part("h1").alias("a"), part("h2").alias("b")).select(F.explode(places).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(size // 64 + 1, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Level(size, probes, turn, words.view(np.uint64))


def _held(keys: DataFrame, level: Level) -> DataFrame:
    """The rows of keys (key, h1, h2) that a filter holds."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            yield batch.filter(pa.array(shared.value.holds(h1, h2)))

    return keys.select("key", "h1", "h2").mapInArrow(kept, "key string, h1 long, h2 long")


def build(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> list[Cascade]:
    """Cascades, one a segment, that tell the keys of listed from the others of universe (both: key; repeats allowed)."""
    every = _hashed(universe)
    own = materialize(_hashed(listed.distinct()), "listed")
    n = own.count()
    if not n:
        discard(own)
        return []
    others = max(1, every.agg(F.approx_count_distinct("h1", 0.02)).first()[0])
    rate = min(0.5, max(2.0**-40, n * math.sqrt(0.5) / others))
    segments = max(1, math.ceil(n * (1.5 * math.log2(1 / rate) + 5) / 8 / max_bytes))
    out = []
    for segment in range(segments):
        mine = (lambda df: df.filter(F.pmod(F.col("h1").bitwiseXOR(F.col("h2")), F.lit(segments)) == segment)) if segments > 1 else lambda df: df  # noqa: B023
        cascade = Cascade(segment=segment, segments=segments)
        held = mine(own)
        cascade.levels.append(_level(held, held.count(), rate, 0))
        # The corpus's keys that level 0 takes for listed; these, and no more, are told apart by the levels below.
        wrong = materialize(_held(mine(every), cascade.levels[0]).distinct().join(own.select("key"), "key", "left_anti"), "wrong")
        pair, used = [held, wrong], [wrong]
        while (count := pair[1].count()) and len(cascade.levels) < MOST_LEVELS:
            level = _level(pair[1], count, 0.5, 11 * len(cascade.levels) % 64)
            cascade.levels.append(level)
            rest = materialize(_held(pair[0], level), "rest")
            used.append(rest)
            pair = [pair[1], rest]
        if count:
            raise RuntimeError("keys with equal 128-bit hashes, or filters that do not tell keys apart")
        for table in used:
            discard(table)
        out.append(cascade)
    discard(own)
    return out


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys of host and path: (shape, size, h1, h2, key) for each pair (labels, characters) that they have."""
    labels, host, path = F.col("labels"), F.col("host"), F.col("path")
    found = []
    for number, (depth, length) in enumerate(shapes):
        suffix = F.when(F.size(labels) == depth, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - depth + 1), depth), "."))
        key = F.concat(suffix, F.substring(path, 1, length))
        fits = (host != "") & (F.size(labels) >= depth) & (F.length(path) >= length)
        found.append(F.when(fits, F.struct(F.lit(number).alias("shape"), key.alias("key"))))
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url) by rules (host, path, verdict allow or block)."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    listed = listed.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("depth"), F.length("path").alias("length"), "verdict")
    # As many pairs as rules have numbers of labels and of characters: by the limits of DNS and of URLs 127 x 2,083 at most.
    shapes = sorted((r["depth"], r["length"]) for r in listed.select("depth", "length").distinct().collect())
    if not shapes:
        return cut.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = cut.withColumn("labels", F.split("host", r"\.")).select("page_id", "host", "path", _keys(shapes).alias("keys"))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    named = build(listed.select("key"), universe, max_bytes)
    blocking = build(listed.filter("verdict = 'block'").select("key"), listed.select("key"), max_bytes)
    hashes = F.transform("keys", lambda k: F.struct(k["shape"], F.length(k["key"]).alias("size"), F.xxhash64(F.lit(1), k["key"]).alias("h1"), F.xxhash64(F.lit(2), k["key"]).alias("h2")))
    rows = keyed.select("page_id", "host", "path", hashes.alias("keys"), F.lit(-1).cast("long").alias("best"), F.lit(False).alias("blocks"))
    passes = [(c, None) for c in named] + [(None, c) for c in blocking]
    if len(named) == 1 and len(blocking) <= 1:
        rows = _looked_up(rows, [(named[0], blocking[0] if blocking else None)])
    else:
        for each in passes:
            rows = materialize(_looked_up(rows, [each]), "judged")
    # Rebuild the winner's string from its shape.
    pair = F.element_at(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n).alias("length")) for d, n in shapes]), (F.pmod(F.col("best"), F.lit(_SHAPES)) + 1).cast("int"))
    labels = F.split("host", r"\.")
    rule = F.concat(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - pair["depth"] + 1), pair["depth"]), "."), F.substring("path", F.lit(1), pair["length"]))
    has = F.col("best") >= 0
    verdict = F.when(has & F.col("blocks"), "block").when(has, "allow").otherwise(default)
    return rows.select("page_id", "host", "path", F.when(has, rule).alias("rule"), verdict.alias("verdict"))


def _looked_up(rows: DataFrame, cascades: list[tuple[Cascade | None, Cascade | None]]) -> DataFrame:
    """rows with best (the score of the longest listed key so far) and blocks (whether it is a blocking one)."""
    shared = rows.sparkSession.sparkContext.broadcast(cascades)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten()
            owner = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            shape, size, h1, h2 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            score = size.astype(np.int64) * _SHAPES + shape
            best = batch.column("best").to_numpy(zero_copy_only=False).copy()
            blocks = batch.column("blocks").to_numpy(zero_copy_only=False).copy()
            for names, blocking in shared.value:
                if names is not None:
                    hit = names.listed(h1, h2)
                    np.maximum.at(best, owner[hit], score[hit])
                if blocking is not None:
                    won = np.flatnonzero(score == best[owner])
                    blocks[owner[won]] |= blocking.listed(h1[won], h2[won])
            columns = [best if c == "best" else blocks if c == "blocks" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], batch.schema.names)

    return rows.mapInArrow(looked, rows.schema)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules AS (SELECT * FROM (VALUES {_VALUES}) v(h, p, verdict)),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT host, path, max((length(h || p), h || p, verdict)) AS best FROM (SELECT DISTINCT host, path FROM cut) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], 'allow') AS verdict FROM cut LEFT JOIN fits USING (host, path)
"""


def op13_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
