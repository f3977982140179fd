"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets. Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the words of all
documents; a target stops at `most` times its source's size and the rest is shared again by weight.
A source gives floor(target / size) whole passes over its documents and a part of one more.

Blocks. A source's documents are dealt by hash into about sqrt(rows) / 4 blocks, in an order that is a
hash too. The part pass takes blocks in that order while they fit; of the first block that does not fit
it takes (or, for more than half of it, leaves) documents in hashed order while they fit, and goes over
the rest four times more, from the longest, for what still fits, and the last one may be over by less
than would be missing without it. So only sums of blocks are ordered as a whole, and one block of each source.

Tree. What a source gives is a quota of blocks. At each node of a binary tree over the output shards
half of the node's blocks, drawn without replacement, go left: the counts by source are then multivariate
hypergeometric, quotas are met exactly, and no block is drawn twice. Each shard's rows carry a hashed
place to be sorted by (`mixed`), a local shuffle.

Only DataFrame functions are used and every draw is a hash of the seed and the row, so reruns agree.
Nulls: a null text has size 0; a null source is a source of its own; null doc_ids are rows like others.
Rows equal in all that is asked for are numbered and drawn one by one, so a group of repeated rows does
not go in or out as a whole. A source without words has target 0 and none of its rows are taken. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import identity, materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 5


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, target, blocks of each source; sizes has source, source_size and rows."""
    ordered = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    ordered = ordered.withColumn("top", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("top") / F.col("weight"))
    # Level at which all targets are weight x level, with the sources that fill up first at their top.
    by_fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    leveled = ordered.withColumn("level", (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    leveled = leveled.withColumn("right", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    target = F.least(F.col("top"), F.coalesce(F.col("weight") * F.col("right"), F.col("top"))).cast("double")
    blocks = F.greatest(F.lit(1), F.floor(F.sqrt("rows") / 4)).cast("long")
    return leveled.select("source", "source_size", target.alias("target"), blocks.alias("blocks"))


def _split(tickets: DataFrame, levels: int, seed: int) -> DataFrame:
    """tickets (source, pass, block) with the shard, of 2**levels, that the tree leads each to."""
    out = tickets.withColumn("shard", F.lit(0))
    for level in range(levels):
        draw = F.xxhash64(F.lit(seed), F.lit(100 + level), "source", "pass", "block")
        node = Window.partitionBy("shard")
        out = out.withColumns({"_at": F.row_number().over(node.orderBy(draw, "source", "pass", "block")), "_of": F.count(F.lit(1)).over(node)})
        # An odd block goes left or right by the node's own hash.
        half = F.floor((F.col("_of") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "shard"), F.lit(2))) / 2)
        out = out.withColumn("shard", F.col("shard") * 2 + F.when(F.col("_at") <= half, 0).otherwise(1)).drop("_at", "_of")
    return out


def decide(rows: DataFrame, names: list[str], shards: int = 16, most: float = 3.0, seed: int = 0) -> DataFrame:
    """names, source, size, source_size, target and draws, the shards that take the row (repeats: taken more than once).

    rows has the columns that tell rows apart, source and size, a row for each document; equal rows get draws each.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    counted = materialize(rows.groupBy(*names, "source", "size").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("rows"))
    plan = materialize(targets(sources, most), "targets").withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("int"))
    plan = plan.withColumn("part", F.when(F.col("passes") < most, F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0.0))
    single = numbered(counted, F.lit(1).cast("long"), "_n", "_i").select(*names, "source", "size", "_i")
    named = plan.withColumnRenamed("source", "_source")
    single = single.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    single = single.withColumn("draw", F.xxhash64(F.lit(seed), *names, "_i")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("blocks")))

    sums = single.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(order))
    sums = sums.withColumn("whole", F.col("upto") <= F.col("part")).withColumn("left", F.col("part") - (F.col("upto") - F.col("words")))
    sums = materialize(sums.withColumn("edge", ~F.col("whole") & (F.col("left") > 0)), "blocks")

    # The one block of each source that fits in part: documents in hashed order, then what still fits.
    edge = sums.filter("edge").select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("left").alias("room"), F.col("words"))
    tried = single.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).select(*names, "source", "size", "_i", "draw", "room", "words")
    # If more than half of the block goes in, what stays out is chosen: there is then more left to choose from.
    tried = tried.withColumn("turned", F.col("room") * 2 > F.col("words"))
    tried = tried.withColumns({"room": F.when(F.col("turned"), F.col("words") - F.col("room")).otherwise(F.col("room")), "picked": F.lit(False)})
    for turn in range(PASSES):
        fits = ~F.col("picked") & (F.col("size") <= F.col("room"))
        first = [F.xxhash64(F.lit(turn), "draw")] if turn == 0 else [F.desc("size")]
        by_turn = Window.partitionBy("source").orderBy(*first, "draw", *names, "_i").rowsBetween(Window.unboundedPreceding, 0)
        tried = tried.withColumn("_sum", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(by_turn))
        tried = tried.withColumn("_new", fits & (F.col("_sum") <= F.col("room")))
        used = F.sum(F.when(F.col("_new"), F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
        tried = tried.withColumn("room", F.col("room") - used).withColumn("picked", F.col("picked") | F.col("_new"))
    # Last, the document that comes nearest to the words still missing, if that is nearer than none.
    nearest = Window.partitionBy("source").orderBy("picked", F.abs(F.col("size") - F.col("room")), "draw", *names, "_i")
    tried = tried.withColumn("_near", F.row_number().over(nearest))
    tried = tried.withColumn("picked", F.col("picked") | ((F.col("_near") == 1) & (F.col("size") < F.col("room") * 2)))
    tried = tried.withColumn("in", F.col("picked") != F.col("turned"))
    chosen = tried.filter("in").select(*[F.col(c).alias("_" + c) for c in names], F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_i").alias("_j"), F.lit(True).alias("in"))

    last = F.when(F.col("whole") | F.col("edge"), F.array(F.col("passes") + 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(F.array().cast("array<int>")), last)
    tickets = sums.select("source", "block", F.col("edge"), F.col("passes"), F.explode(numbers).alias("pass"))
    tickets = _split(tickets, int(math.log2(shards)), seed)
    partial = F.col("edge") & (F.col("pass") > F.col("passes"))
    given = tickets.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.when(~partial, F.col("shard")))).alias("sure"), F.max(F.when(partial, F.col("shard"))).alias("maybe")
    ).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "sure", "maybe")
    out = single.join(given, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left").drop("_source", "_block")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_i") == F.col("_j"))
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    out = out.join(chosen, same, "left")
    none = F.array().cast("array<int>")
    draws = F.concat(F.coalesce("sure", none), F.when(F.col("in"), F.array("maybe")).otherwise(none))
    return out.select(*names, "source", "size", "source_size", "target", draws.alias("draws"))


def mix_report(docs: DataFrame, shards: int = 16, most: float = 3.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    out = decide(rows, ["doc_id", "mark"], shards, most, seed)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws")


def mixed(docs: DataFrame, shards: int = 16, most: float = 3.0, seed: int = 0, shard: str = "shard", place: str = "place") -> DataFrame:
    """The mix: rows of docs, as often as they are drawn, with their shard and hashed place in it.

    The columns of docs may have any names but those of the two new ones, or ValueError is raised.
    """
    taken = {c.lower() for c in docs.columns} & {shard.lower(), place.lower()}
    if taken:
        raise ValueError(f"column {', '.join(sorted(taken))} exists already")
    # Rows are told apart by all their columns, nulls included, and travel as one column.
    own = identity(*docs.columns)
    rows = docs.select(own.alias("own"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    plan = decide(rows, ["own"], shards, most, seed).select("own", F.explode("draws").alias("s"))
    # Repeated rows are one row with the sum of their draws; at most `shards` entries each.
    plan = plan.groupBy("own", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("own").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("taken"))
    keyed = docs.select(own.alias("own"), F.struct("*").alias("row"))
    kept = keyed.join(plan, "own").withColumn("first", F.row_number().over(Window.partitionBy("own").orderBy("own"))).filter("first = 1")
    drawn = kept.select("row", "own", F.explode("taken").alias("t")).select("row", "own", F.col("t.s").alias("s"), F.col("t.n").alias("n"))
    drawn = numbered(drawn, F.lit(1).cast("long"), "n", "copy")
    return drawn.select("row.*", F.col("s").alias(shard), F.xxhash64(F.lit(seed), "s", "own", "copy").alias(place))
