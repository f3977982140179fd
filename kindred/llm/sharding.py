"""Rendezvous sharding of records by a stable key over weighted shards (DataFrame functions only).

Every shard draws a uniform number from the key's hash; the record goes to the shard with the least
-ln(u) / weight. Adding a shard adds one more draw, so the only records that move are those the new
shard wins. Each record is placed on its own: no shuffle, no state, no skew.

Nulls: a null key hashes like any other value, so all its records share a shard. Equal keys share a
shard. An empty table gives an empty table. Other columns pass through; an output column that exists
already raises ValueError instead of being overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import numbered


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Index of the shard that wins key; ties go to the lower index."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = []
    for shard, weight in enumerate(weights):
        h = F.xxhash64(F.lit(seed), F.lit(shard), key)
        u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.least(*draws)["shard"] if len(draws) > 1 else F.lit(0)


def assign_shards(
    df: DataFrame, key: str, shards: int | Sequence[float], seed: int = 0, out: str = "shard"
) -> DataFrame:
    """df with the shard of each row; shards is a count or a list of weights."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    return df.withColumn(out, rendezvous(F.col(key), weights, seed))


def number_slots(df: DataFrame, shard: str, columns: Sequence[str], out: str = "slot", cells: int = 256) -> DataFrame:
    """Rows of df (columns and shard only) with gapless places from 0 within each shard.

    Equal rows are counted before any shuffle and numbered as one run, so a group of copies of any
    size is one row until it is written, and then made in ranges of 4,096. The rest is numbered in hashed cells of each shard: the cells'
    totals (shards x cells rows at most) give each cell's first place, and only a cell is sorted as a whole.
    """
    columns = list(columns)
    runs = df.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_cell", F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(cells)))
    totals = runs.groupBy(shard, "_cell").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(
        F.col(shard).alias("_shard"), F.col("_cell").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first")
    )
    within = Window.partitionBy(shard, "_cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    joined = placed.join(F.broadcast(firsts), (F.col(shard) == F.col("_shard")) & (F.col("_cell") == F.col("_of")))
    return numbered(joined, F.col("_first") + F.col("_at"), "_n", out).select(shard, *columns, out)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Law `key` for documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 length plus 8 (null text: 8, crc of no bytes). grown_shard is the shard
    with one shard more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = number_slots(assign_shards(keyed, "doc_id", shards, seed), "shard", ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", rendezvous(F.col("doc_id"), [1.0] * (shards + 1), seed).cast("int").alias("grown_shard"),
    )
