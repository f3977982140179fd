"""The linkage pipeline from raw records to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions.text import enriched
from kindred.operators import matching, model, threshold, training
from kindred.operators.blocking import PASSES, all_candidates, candidate_pairs, key_index
from kindred.operators.features import pair_features
from kindred.sources.scratch import written


def rule_predictions(pairs: DataFrame, source1: DataFrame, target: DataFrame) -> DataFrame:
    """PAIR and prediction_probability by a fixed rule on token overlaps, where no model has been trained."""
    side = lambda df, mark: enriched(df).select(*[F.col(c).alias(mark + c) for c in ("entity_id", "business_name_tokens", "address_tokens", "address_numbers")])
    other = "target_entity_id" if "target_entity_id" in pairs.columns else "candidate_entity_id"
    both = pairs.join(side(source1, "a_"), F.col("source1_entity_id") == F.col("a_entity_id")).join(side(target, "b_"), F.col(other) == F.col("b_entity_id"))
    names = sim.jaccard(F.col("a_business_name_tokens"), F.col("b_business_name_tokens"))
    words = sim.jaccard(F.col("a_address_tokens"), F.col("b_address_tokens"))
    numbers = sim.overlap(F.col("a_address_numbers"), F.col("b_address_numbers")).cast("double")
    return both.select("source1_entity_id", F.col(other).alias("target_entity_id"), F.round(names * 0.6 + words * 0.3 + numbers * 0.1, 4).alias("prediction_probability"))


def match_by_rule(source1: DataFrame, targets: dict[str, DataFrame], least: float, passes=PASSES) -> DataFrame:
    """Result lists of all of source 1, by the rule."""
    source1 = written(enriched(source1), "source1")
    out, index = None, key_index(source1, passes)
    for name, target in targets.items():
        target = written(enriched(target), name)
        own = rule_predictions(all_candidates(index, {name: target}, passes=passes), source1, target)
        out = own if out is None else out.unionByName(own)
    return matching.lists(source1, matching.accepted(out, least))


def train_and_match(source1: DataFrame, targets: dict[str, DataFrame], truth: DataFrame, path: str | None = None, **options) -> tuple[DataFrame, dict, object]:
    """Predictions of all candidates, the best threshold and the fitted model, from records and true pairs.

    The model is fitted on the training side of a split by entity; the threshold is chosen on the other side.
    """
    # Normalised records, keys and features are read for fitting and again for scoring: they are written once, in shared storage.
    source1 = written(enriched(source1), "source1")
    index, featured = key_index(source1), None
    for name, target in targets.items():
        target = written(enriched(target), name)
        pairs = training.marked_pairs(candidate_pairs(index, target), training.positives(truth, source1, target))
        pairs = training.grouped_split(training.marked_negatives(pairs).withColumn("source", F.lit(name)))
        own = written(pair_features(pairs, source1, target), "features")
        featured = own if featured is None else featured.unionByName(own)
    rows = training.check_split(featured.filter("kept").drop("kept", "offered"))
    config = model.TreeConfig(**options)
    fitted = model.train(rows, config)
    held = model.score(fitted, rows.filter("is_validation"))
    best = threshold.best(threshold.sweep(held, truth)).first().asDict()
    if path:
        model.save(fitted, path, best, config)
    scored = model.score(fitted, featured.filter("offered"))
    return scored.select("source1_entity_id", "target_entity_id", F.col("source").alias("target_source"), "prediction_probability"), best, fitted
