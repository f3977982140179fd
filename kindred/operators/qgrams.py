"""q-gram blocking: pairs of records of one country whose names share enough q-grams (Jaccard similarity).

A join on all shared q-grams would meet on the frequent ones. Each name's q-grams are put in one order, rarest first; a
name of n q-grams shares ceil(t n) at least with a similar one, so the first two that they share stand among the first
n - ceil(t n) + 2 of both (prefix filter). Names meet by two q-grams at once: by one, what meets grows with the number of
names times that of names with the q-gram, hundreds for each. What meets goes no further where the lengths (the shorter has
at least the share t of the longer's) or 64 bits of either side tell that too many q-grams differ: bits that differ never
outnumber them. What is left is compared exactly. Only distinct names are joined, so equal names cost one row whatever
their number, and records come in at the end.

Frequencies are a table joined by q-gram; nothing is broadcast that grows. A name without characters has no q-grams and
no pair; one shorter than q has itself as its only one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import enriched
from kindred.sources.scratch import written


def qgrams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text, in order of their first place."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - q + 1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(q)))))


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.6, q: int = 3) -> DataFrame:
    """country, left_name, right_name, similarity of names (country, name; repeats allowed) that are similar enough."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    both = left.select("country", "name", F.lit(1).alias("side")).unionByName(right.select("country", "name", F.lit(2).alias("side")))
    both = both.filter(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("country", "name").agg(F.bool_or(F.col("side") == 1).alias("l"), F.bool_or(F.col("side") == 2).alias("r"))
    # Names and q-grams go by number: what is sorted, exploded and met is numbers, never texts.
    names = written(both.withColumn("grams", qgrams(F.col("name"), q)).withColumn("name_id", F.monotonically_increasing_id()), "names")
    grams = names.select("name_id", "country", F.explode("grams").alias("gram"))
    frequency = grams.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("n"))
    frequency = written(frequency.withColumn("gram_id", F.monotonically_increasing_id()), "grams")
    ranked = grams.join(frequency, ["country", "gram"]).groupBy("name_id").agg(F.array_sort(F.collect_list(F.struct("n", "gram_id"))).alias("ranked"))
    ids, size = F.col("ranked.gram_id"), F.size("ranked")
    ranked = ranked.select("name_id", ids.alias("ids"), size.alias("size"), F.ceil(size * least - 1e-9).cast("int").alias("shared"))
    heads = written(names.select("name_id", "l", "r").join(ranked.select("name_id", "size", head_keys().alias("keys"), bit_set().alias("bits")), "name_id"), "heads")
    mine = heads.filter("l").select(F.explode("keys").alias("key"), F.col("name_id").alias("left_id"), F.col("size").alias("left_size"), F.col("bits").alias("left_bits"))
    theirs = heads.filter("r").select(F.explode("keys").alias("key"), F.col("name_id").alias("right_id"), F.col("size").alias("right_size"), F.col("bits").alias("right_bits"))
    met = mine.join(theirs, "key")
    shorter, longer = F.least("left_size", "right_size"), F.greatest("left_size", "right_size")
    apart = F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits")))
    near = (shorter >= longer * least - 1e-9) & (apart <= (F.col("left_size") + F.col("right_size")) * ((1 - least) / (1 + least)) + 1e-9)
    met = met.filter(near).select("left_id", "right_id").distinct()
    for side in ("left", "right"):
        more = ["country"] if side == "left" else []
        met = met.join(names.select(*more, F.col("name_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("grams").alias(f"{side}_grams")), f"{side}_id")
    shared = F.size(F.array_intersect("left_grams", "right_grams"))
    met = met.withColumn("similarity", shared / (F.size("left_grams") + F.size("right_grams") - shared))
    return met.filter(F.col("similarity") >= least).select("country", "left_name", "right_name", "similarity")


def head_keys() -> Column:
    """Keys of a name by its ids, rarest first, and the number it must share: all twos of its first size - shared + 2; for
    a name that need share one only, its first size - shared + 1 too."""
    twos = "flatten(transform(slice(ids, 1, size - shared + 2), (x, i) -> transform(slice(ids, i + 2, greatest(0, size - shared + 1 - i)), y -> xxhash64(x, y))))"
    ones = "transform(slice(ids, 1, size - shared + 1), x -> xxhash64(x))"
    return F.expr(f"array_distinct(if(shared < 2, concat({twos}, {ones}), {twos}))")


def bit_set() -> Column:
    """64 bits, one set for each id by its hash."""
    return F.expr("aggregate(ids, 0L, (a, g) -> a | shiftleft(1L, cast(pmod(xxhash64(g), 64) as int)))")


def qgram_pairs(source1: DataFrame, target: DataFrame, least: float = 0.6, q: int = 3, column: str = "business_name_normalized") -> DataFrame:
    """source1_entity_id, candidate_entity_id of records of one country with similar names."""

    def side(records: DataFrame, out: str) -> DataFrame:
        df = enriched(records)
        return df.select(F.col("entity_id" if "entity_id" in df.columns else df.columns[0]).alias(out), F.col("country_normalized").alias("country"), F.col(column).alias("name"))

    mine, theirs = written(side(source1, "source1_entity_id"), "left"), written(side(target, "candidate_entity_id"), "right")
    pairs = similar_names(mine, theirs, least, q)
    out = mine.withColumnRenamed("name", "left_name").join(pairs, ["country", "left_name"]).join(theirs.withColumnRenamed("name", "right_name"), ["country", "right_name"])
    return out.select("source1_entity_id", "candidate_entity_id").distinct()
