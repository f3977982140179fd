"""Blocking recall, missed pairs, audits of normalisation and profiles of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.tsv import write_tsv

PAIR = ["source1_entity_id", "target_entity_id"]


def as_pairs(candidates: DataFrame) -> DataFrame:
    other = "candidate_entity_id" if "candidate_entity_id" in candidates.columns else PAIR[1]
    return candidates.select(PAIR[0], F.col(other).alias(PAIR[1])).distinct()


def missed_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select(*PAIR).distinct().join(as_pairs(candidates), PAIR, "left_anti")


def missed_report(candidates: DataFrame, truth: DataFrame, source1: DataFrame, target: DataFrame) -> DataFrame:
    """Missed pairs with both records' names and addresses."""
    side = lambda df, mark, key: df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{mark}_name"), F.col("business_address").alias(f"{mark}_address"))
    missed = missed_pairs(candidates, truth)
    return missed.join(side(source1, "source1", PAIR[0]), PAIR[0]).join(side(target, "target", PAIR[1]), PAIR[1])


def blocking_recall(candidates: DataFrame, truth: DataFrame, source1: DataFrame) -> DataFrame:
    """One row: n_truth, n_found, recall, n_candidates, candidates_per_entity."""
    marked = as_pairs(candidates).withColumn("c", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full_outer")
    counts = marked.agg(F.count("t").alias("n_truth"), F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("n_found"), F.count("c").alias("n_candidates"))
    n = source1.agg(F.countDistinct("entity_id").alias("n_entities"))
    # Both sides are one row.
    both = counts.join(F.broadcast(n), F.lit(True))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return both.select("n_truth", "n_found", ratio("n_found", "n_truth").alias("recall"), "n_candidates", ratio("n_candidates", "n_entities").alias("candidates_per_entity"))


def audit(enriched: DataFrame) -> DataFrame:
    """One row of counters over an enriched source."""
    counters = {
        "names_changed": F.col("business_name") != F.col("business_name_normalized"),
        "suffixes_removed": F.col("business_name_normalized") != F.col("business_name_core"),
        "addresses_changed": F.col("business_address") != F.col("business_address_normalized"),
        "postal_codes": F.col("postal_code") != "",
        "addresses_with_numbers": F.size("address_numbers") > 0,
        "countries_changed": F.col("country") != F.col("country_normalized"),
    }
    total = F.count(F.lit(1))
    share = {f"{k}_percent": F.when(total > 0, F.count_if(v) * 100.0 / total) for k, v in counters.items()}
    return enriched.agg(total.alias("n_records"), *[F.count_if(v).alias(k) for k, v in counters.items()], *[v.alias(k) for k, v in share.items()])


def write_audit(enriched: DataFrame, path: str, n: int = 500) -> None:
    """The audit's counters as JSON at path/audit, and the first n records by id with their derived columns as TSV at path/sample."""
    audit(enriched).coalesce(1).write.mode("overwrite").json(f"{path}/audit")
    flat = enriched.orderBy("entity_id").limit(n).select(*[F.array_join(c, " ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in enriched.dtypes])
    write_tsv(flat.coalesce(1), f"{path}/sample")


def profile(records: DataFrame) -> DataFrame:
    """One row: sizes, distinct values, missing addresses and lengths of a source."""
    name, address = F.col("business_name"), F.col("business_address")
    return records.agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("entity_id").alias("n_ids"), F.countDistinct(name).alias("n_names"), F.countDistinct(address).alias("n_addresses"),
        F.count_if(F.trim(address) == "").alias("missing_addresses"), F.min(F.length(name)).alias("min_name"), F.max(F.length(name)).alias("max_name"), F.avg(F.length(name)).alias("avg_name"),
    )


def frequent(values: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values and their counts."""
    return values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def match_cardinality(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """n_matches, n_entities: how many entities have how many matches."""
    counts = truth.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n"))
    ids = entities.select(F.col(entities.columns[0]).alias(PAIR[0])).distinct()
    return ids.join(counts, PAIR[0], "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_matches")).agg(F.count(F.lit(1)).alias("n_entities"))


def source_overlap(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """sources (such as S2+S3, or none), n_entities: in which sources entities have matches."""
    has = truth.select(PAIR[0], F.substring(PAIR[1], 1, 2).alias("s")).distinct().groupBy(PAIR[0]).agg(F.array_join(F.array_sort(F.collect_set("s")), "+").alias("sources"))
    ids = entities.select(F.col(entities.columns[0]).alias(PAIR[0])).distinct()
    return ids.join(has, PAIR[0], "left").groupBy(F.coalesce("sources", F.lit("none")).alias("sources")).agg(F.count(F.lit(1)).alias("n_entities"))
