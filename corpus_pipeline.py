"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next.

run(spark, sf_dir) gives what the last stage gives: a row for each document of the mix, in the token
files' order of doc_id. The stages hold fitted models and hashes that SQL has no words for, so there is
no oracle; tests hold them against brute force.

Every stage but the last returns whole rows of its input, with all their columns, whatever their names. Nulls:
a null text is an empty one for the classifier, is a copy of other texts without words, holds no benchmark passage, has size 0 and
the end id alone as its ids; rows with a null doc_id are rows like others, a null source is a source of its own.
Repeated rows share the classifier's and the decontamination's decision, the near-dedup keeps one of them. Ties
go to the least doc_id, then to the least hash. Of a very long text each stage works on some part at a time, save
its list of words. An empty table goes through as one.
"""

from __future__ import annotations

import public_tokenizers

from kindred.llm import quality, tokens
from kindred.llm.common import fresh_name, load, materialize, scratch_path, small_batches
from kindred.llm.decontaminate import clean_documents
from kindred.llm.mixing import mixed
from kindred.llm.near_dedup import deduplicate

#: Words whose ids the token stage keeps in a task, texts of its Arrow batches, and code points it cuts at once: executors
#: hold what earlier stages grew to.
CACHE_WORDS, TEXTS, AT_ONCE = 300_000, 500, 1 << 20


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier does not reject."""
    return quality.keep_documents(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def simhash_near_dedup(spark, docs, sf_dir):
    """One document, that with the least doc_id, of each group linked at a Jaccard similarity of 0.8 over 5-word shingles."""
    return deduplicate(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixed(docs, shard=fresh_name(docs, "shard"), place=fresh_name(docs, "place")).select(*[f"`{c}`" for c in docs.columns])


def token_ids(spark, docs, sf_dir):
    """Token-ID files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "ids")
    with small_batches(spark, TEXTS):
        tokens.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), cache_words=CACHE_WORDS, at_once=AT_ONCE)
    return tokens.read_documents(spark, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_ids),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
