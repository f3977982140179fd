"""The queries of the corpus operators: one opN_<name> each, over whole tables."""

from __future__ import annotations

import public_tokenizers

from kindred.llm import chat, filter_audit, line_dedup, lm_score, media, panes, quality, tokens, url_filter
from kindred.llm.common import load, scratch_path
from kindred.llm.simhash import near_duplicates
from kindred.llm.decontaminate import contaminated
from kindred.llm.mixing import mix_report
from kindred.llm.sharding import shard_documents


def op1_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"))


def op2_cross_entropy_difference(spark, sf_dir):
    return lm_score.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_snapshot_collapse(spark, sf_dir):
    return chat.render(load(spark, sf_dir, "conversations"))


def op4_benchmark_decontamination(spark, sf_dir):
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_flac_media(spark, sf_dir):
    # All that follows comes from the stored form's bytes, the binary column; see README.md for writing it as a table.
    return media.digest(media.encode_text(load(spark, sf_dir, "documents")))


def op6_mixing_tree(spark, sf_dir):
    return mix_report(load(spark, sf_dir, "documents"))


def op7_line_chunk_dedup(spark, sf_dir):
    return line_dedup.report(load(spark, sf_dir, "documents"))


def op8_rendezvous_sharding(spark, sf_dir):
    return shard_documents(load(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op10_repair_token_ids(spark, sf_dir):
    path = scratch_path(spark, "ids")
    tokens.write_ids(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_documents(spark, path)


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_cross_entropy_difference": op2_cross_entropy_difference,
    "op3_snapshot_collapse": op3_snapshot_collapse,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_flac_media": op5_flac_media,
    "op6_mixing_tree": op6_mixing_tree,
    "op9_quality_classifier": op9_quality_classifier,
    "op7_line_chunk_dedup": op7_line_chunk_dedup,
    "op8_rendezvous_sharding": op8_rendezvous_sharding,
    "op10_repair_token_ids": op10_repair_token_ids,
    "op11_pane_revisions": panes.op11_pane_revisions,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_url_cascade": url_filter.op13_url_cascade,
}

ORACLES: dict[str, str] = {
    "op2_cross_entropy_difference": lm_score.ORACLE,
    "op3_snapshot_collapse": chat.ORACLE,
    "op7_line_chunk_dedup": line_dedup.ORACLE,
    "op11_pane_revisions": panes.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_url_cascade": url_filter.ORACLE,
}
