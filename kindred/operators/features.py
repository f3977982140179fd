"""The twelve features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions.constants import DERIVED, FEATURES
from kindred.functions.text import enriched
from kindred.operators.validate import require


def _side(records: DataFrame, mark: str) -> DataFrame:
    df = enriched(records)
    key = "entity_id" if "entity_id" in df.columns else df.columns[0]
    return df.select(F.col(key).alias(f"{mark}id"), *[F.col(c).alias(mark + c) for c in DERIVED])


def pair_features(pairs: DataFrame, source1: DataFrame, target: DataFrame) -> DataFrame:
    """pairs (source1_entity_id, target_entity_id or candidate_entity_id, other columns) with FEATURES.

    Pairs with an id that its side does not have are left out.
    """
    other = "target_entity_id" if "target_entity_id" in pairs.columns else "candidate_entity_id"
    require(pairs, ["source1_entity_id", other], "pairs")
    both = pairs.join(_side(source1, "a_"), F.col("source1_entity_id") == F.col("a_id")).join(_side(target, "b_"), F.col(other) == F.col("b_id"))
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    name, core, address = "business_name_normalized", "business_name_core", "business_address_normalized"
    missing = (a(address) == "") | (b(address) == "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = [
        sim.levenshtein_ratio(a(name), b(name)),
        sim.jaro_winkler_ratio(a(name), b(name)),
        sim.levenshtein_ratio(a(core), b(core)),
        sim.token_sort_ratio(a(core), b(core)),
        sim.token_set_ratio(a(core), b(core)),
        sim.jaccard(a("business_name_tokens"), b("business_name_tokens")),
        F.when(missing, F.lit(0.0)).otherwise(sim.levenshtein_ratio(a(address), b(address))),
        F.when(missing, F.lit(0.0)).otherwise(sim.jaccard(a("address_tokens"), b("address_tokens"))),
        flag((a("postal_code") == b("postal_code")) & (a("postal_code") != "")),
        flag(sim.overlap(a("address_numbers"), b("address_numbers"))),
        flag((a("country_normalized") == b("country_normalized")) & (a("country_normalized") != "")),
        flag(missing),
    ]
    return both.select(*[F.col(c) for c in pairs.columns], *[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])
