"""Sorted-neighbourhood blocking: records of both sides in one order, pairs of different sides less than `window` apart.

The order is (country, sort key, side, id), so a country is a run of it. It is total, and positions are exact at any
size without one sorted task: rows are dealt by ranges of the order, each range is numbered on its own, and the ranges'
sizes, one number each, give the first position of each. Positions are cut into blocks; the last rows of a block are
copied into the next, so that a block finds by itself all pairs whose later row it holds. Equal keys, however many,
are told apart by side and id: they fall into many ranges and blocks, and a row has window - 1 rows before it at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.text import enriched
from kindred.sources.scratch import written

#: Positions of a block.
BLOCK = 20_000


def _side(records: DataFrame, side: int, key: Column) -> DataFrame:
    df = enriched(records)
    name = "entity_id" if "entity_id" in df.columns else df.columns[0]
    return df.select(F.col("country_normalized").alias("country"), key.alias("key"), F.lit(side).alias("side"), F.col(name).alias("id"))


def positions(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with pos, their place from 0 in the order of columns that tell all rows apart."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range", first.alias("first"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("at", at).join(F.broadcast(starts), "range").withColumn("pos", F.col("first") + F.col("at")).drop("range", "at", "first")


def neighbour_pairs(source1: DataFrame, target: DataFrame, window: int = 10, key: Column | None = None, block: int = BLOCK) -> DataFrame:
    """source1_entity_id, candidate_entity_id of records of one country less than window places apart by key (the core name)."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    block = max(block, window)
    key = F.col("business_name_core") if key is None else key
    rows = positions(_side(source1, 1, key).unionByName(_side(target, 2, key)), ["country", "key", "side", "id"])
    home = F.floor(F.col("pos") / block)
    into = F.when(F.pmod("pos", F.lit(block)) > block - window, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.select("country", "side", "id", "pos", home.alias("home"), F.explode(into).alias("block"))
    before = Window.partitionBy("block").orderBy("pos").rowsBetween(-(window - 1), -1)
    rows = rows.withColumn("near", F.collect_list(F.struct("country", "side", "id")).over(before)).filter("block = home")
    pairs = rows.select("country", "side", "id", F.explode("near").alias("other"))
    pairs = pairs.filter((F.col("other.side") != F.col("side")) & (F.col("other.country") == F.col("country")))
    own, its = (F.when(F.col("side") == s, F.col("id")).otherwise(F.col("other.id")) for s in (1, 2))
    return pairs.select(own.alias("source1_entity_id"), its.alias("candidate_entity_id")).distinct()
