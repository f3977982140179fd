"""Accepted matches, result lists, and statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accepted(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.filter(F.col("prediction_probability") >= threshold).select("source1_entity_id", "target_entity_id").distinct()


def lists(entities: DataFrame, pairs: DataFrame, out: str = "matched_entity_ids", target: str = "target_entity_id") -> DataFrame:
    """A row for each entity (first column) with its sorted, comma-joined ids; empty if it has none."""
    ids = entities.select(F.col(entities.columns[0]).alias("source1_entity_id")).distinct()
    found = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set(target)), ",").alias(out))
    return ids.join(found, "source1_entity_id", "left").na.fill("", [out])


def one_owner(predictions: DataFrame) -> DataFrame:
    """Predictions with each target at its best entity only."""
    order = Window.partitionBy("target_entity_id").orderBy(F.desc("prediction_probability"), "source1_entity_id")
    return predictions.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at")


def statistics(results: DataFrame) -> DataFrame:
    """n_entities, n_matched, n_singletons, n_links of result lists."""
    links = F.when(F.col("matched_entity_ids") == "", 0).otherwise(F.size(F.split("matched_entity_ids", ",")))
    return results.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(links > 0).alias("n_matched"), F.count_if(links == 0).alias("n_singletons"), F.sum(links).cast("long").alias("n_links"))
