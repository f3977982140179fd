"""Candidate pairs: all blocking passes as one keyed join and one aggregate.

Every record becomes rows (country, kind, key); equal rows of both sides meet in one equi-join, which
hashes on all three, so a country is no unit of work. What a pass asks beyond its key is tested on
the joined rows, and one aggregate per pair unites the passes and counts shared address words. One
aggregate counts each key on both sides. A key with more than HOT_KEY rows of a side is cut: that side's
rows are dealt over as many cells as it takes, the other side's rows go to each of them, so that no task
joins more than HOT_KEY by HOT_KEY rows of a key. Keys are written once a side (key_index), as counting and joining
read them several times: each source is normalised once, and one index serves any number of targets. max_token_df, off by default, drops name words that more
target records than that share.

kinds: token (a name word, or all name words run together), core, postal, number (first of the address), address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.constants import ADDRESS_NOISE, NAME_NOISE
from kindred.functions.similarity import overlap
from kindred.functions.text import enriched, strip_web_domain
from kindred.sources.scratch import written

PASSES = ("token", "core", "postal", "number", "address")
HOT_KEY = 10_000
KEY = ["country", "kind", "key"]


def _id(df: DataFrame) -> str:
    return "entity_id" if "entity_id" in df.columns else df.columns[0]


def keyed(records: DataFrame, passes=PASSES) -> DataFrame:
    """id, country, kind, key of a side's records, with the lists that the kind's residual test needs."""
    df = enriched(records)
    empty = F.array().cast("array<string>")
    words = F.filter("business_name_tokens", lambda t: ~t.isin(NAME_NOISE))
    run = F.array_join(F.transform(words, strip_web_domain), "")
    single = F.filter(F.transform("business_name_tokens", strip_web_domain), lambda t: (F.length(t) >= 3) & ~t.isin(NAME_NOISE))
    numbers, addresses = F.array_distinct("address_numbers"), F.array_distinct("address_tokens")
    keys = {
        "token": F.array_distinct(F.concat(single, F.when(F.length(run) >= 4, F.array(run)).otherwise(empty))),
        "core": F.when(F.length("business_name_core") >= 3, F.array("business_name_core")).otherwise(empty),
        "postal": F.when(F.col("postal_code") != "", F.array(F.lower(F.trim("postal_code")))).otherwise(empty),
        "number": F.when(F.size("address_numbers") > 0, F.array(F.get("address_numbers", F.lit(0)))).otherwise(empty),
        "address": F.filter(addresses, lambda t: (F.length(t) >= 4) & ~t.isin(ADDRESS_NOISE)),
    }

    def tagged(kind: str) -> Column:
        return F.transform(keys[kind], lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    out = df.select(
        F.col(_id(df)).alias("id"), F.col("country_normalized").alias("country"), numbers.alias("_numbers"), addresses.alias("_addresses"),
        F.array_distinct("business_name_tokens").alias("_names"), F.explode(F.concat(*map(tagged, passes))).alias("k"),
    )
    # Only the kinds that test them carry lists through the shuffle.
    kind = F.col("k.kind")
    return out.select(
        "id", "country", kind.alias("kind"), F.col("k.key").alias("key"),
        F.when(kind.isin("postal", "address"), F.col("_numbers")).alias("numbers"),
        F.when(kind.isin("postal", "number"), F.col("_addresses")).alias("addresses"),
        F.when(kind == "number", F.col("_names")).alias("names"),
    )


def key_index(records: DataFrame, passes=PASSES) -> DataFrame:
    """The stored keys of a side, to be given to candidate_pairs in place of its records any number of times."""
    return records if is_key_index(records) else written(keyed(records, passes), "keys")


def is_key_index(df: DataFrame) -> bool:
    return {"id", "country", "kind", "key", "numbers", "addresses", "names"} == set(df.columns)


def _celled(side: DataFrame, marks: DataFrame, own: str, other: str, dealt: str, copied: str) -> DataFrame:
    """side with the cell of each row: by hash over its own cells, and once in each cell of the other side."""
    out = side.join(F.broadcast(marks), KEY, "left")
    out = out.withColumn(dealt, F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1).cast("long"))))
    return out.withColumn(copied, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1).cast("long")) - 1))).drop(own, other)


def candidate_pairs(
    source1: DataFrame, target: DataFrame, passes=PASSES, max_df: int = 100, max_token_df: int | None = None, target_source: str | None = None,
    hot: int = HOT_KEY, address_counts: DataFrame | None = None,
) -> DataFrame:
    """source1_entity_id, candidate_entity_id[, target_source] of the records that some pass brings together.

    Address words that more than max_df target records of the country have are no keys; the count is over the whole
    of target, or is taken from address_counts (country, key, n), where target is only a part of a larger table.
    Either side may be a key_index, of which the keys of other passes are not used.
    """
    left, right = (key_index(side, passes).filter(F.col("kind").isin(*passes)) for side in (source1, target))
    side = lambda df, l, r: df.select(*KEY, F.lit(l).alias("l"), F.lit(r).alias("r"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    limits = {"token": max_token_df} if max_token_df is not None else {}
    limits |= {"address": max_df} if address_counts is None else {}
    common = F.lit(False)
    for kind, most in limits.items():
        common = common | ((F.col("kind") == kind) & (F.col("r") > most))
    cells = lambda n: F.ceil(F.col(n) / F.lit(hot)).cast("long")
    # All keys are counted in one pass; the few that something is done about are written, and read for marks and for limits.
    counts = written(counts.select(*KEY, "l", "r", common.alias("common")).filter((F.col("l") > hot) | (F.col("r") > hot) | F.col("common")), "counts")
    # One key in `hot` rows at most, so that it can be broadcast: 24 bytes and the key for each.
    marks = counts.filter((F.col("l") > hot) | (F.col("r") > hot)).select(*KEY, F.greatest(cells("l"), F.lit(1)).alias("lc"), F.greatest(cells("r"), F.lit(1)).alias("rc"))
    if limits:
        right = right.join(counts.filter("common").select(*KEY), KEY, "left_anti")
    if address_counts is not None:
        known = address_counts.filter(F.col("n") > max_df).select("country", F.lit("address").alias("kind"), "key")
        right = right.join(known, KEY, "left_anti")
    left, right = _celled(left, marks, "lc", "rc", "lcell", "rcell"), _celled(right, marks, "rc", "lc", "rcell", "lcell")
    r = right.select(*KEY, "lcell", "rcell", *[F.col(c).alias(f"t_{c}") for c in ("id", "numbers", "addresses", "names")])
    met = left.join(r, [*KEY, "lcell", "rcell"])
    shared_numbers = overlap(F.col("numbers"), F.col("t_numbers"))
    two_words = F.size(F.array_intersect("addresses", "t_addresses")) >= 2
    direct = (
        F.when(F.col("kind").isin("token", "core"), F.lit(True))
        .when(F.col("kind") == "postal", shared_numbers | two_words)
        .when(F.col("kind") == "number", overlap(F.col("names"), F.col("t_names")) | two_words)
        .otherwise(F.lit(False))
    )
    is_address = F.col("kind") == "address"
    met = met.select("id", "t_id", F.coalesce(direct, F.lit(False)).alias("direct"), is_address.alias("word"), (is_address & shared_numbers).alias("numbered"))
    met = met.filter(F.col("direct") | F.col("word"))
    pairs = met.groupBy("id", "t_id").agg(F.bool_or("direct").alias("direct"), F.count_if("word").alias("words"), F.bool_or("numbered").alias("numbered"))
    pairs = pairs.filter("direct or numbered or words >= 2").select(F.col("id").alias("source1_entity_id"), F.col("t_id").alias("candidate_entity_id"))
    return pairs if target_source is None else pairs.withColumn("target_source", F.lit(target_source))


def all_candidates(source1: DataFrame, targets: dict[str, DataFrame], **options) -> DataFrame:
    """Candidates of several target tables, marked with target_source; the keys of source 1 are made once."""
    out, source1 = None, key_index(source1, options.get("passes", PASSES))
    for name, target in targets.items():
        own = candidate_pairs(source1, target, target_source=name, **options)
        out = own if out is None else out.unionByName(own)
    return out


def address_word_counts(target: DataFrame) -> DataFrame:
    """country, key, n: how many target records have each address word, for candidate_pairs on parts of target."""
    return keyed(target, ("address",)).groupBy("country", "key").agg(F.count(F.lit(1)).alias("n"))
