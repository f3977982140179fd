"""Matching of target records that arrive as a stream, batch by batch, against a fixed source 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.text import enriched
from kindred.operators import matching
from kindred.operators.blocking import candidate_pairs, key_index
from kindred.plans.linkage import rule_predictions
from kindred.sources.scratch import written


def match_stream(source1: DataFrame, target_stream: DataFrame, out_path: str, checkpoint: str, least: float, address_counts: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Write source1_entity_id, target_entity_id of accepted pairs to out_path/batch=N.

    A batch that is run again after a failure overwrites its own folder, so each match is written once. The limit on
    frequent address words counts the records of a batch; with address_counts (country, key, n; see
    blocking.address_word_counts) it counts what that table counted, so that a target gives the same pairs however it is cut.
    """
    fixed = written(enriched(source1), "source1")
    index = key_index(fixed)

    def run(batch: DataFrame, number: int) -> None:
        target = written(enriched(batch), "batch")
        found = rule_predictions(candidate_pairs(index, target, address_counts=address_counts), fixed, target)
        matching.accepted(found, least).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return target_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
