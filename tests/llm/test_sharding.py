import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kindred.llm import sharding


def test_documents(spark):
    rows = [(i, f"text {i % 7}", 1) for i in range(3000)] + [(5, "copy", 2)] * 40 + [(None, None, 3)] * 5 + [(9999, "ü", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard == r.shard or r.grown_shard == 24
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 24 for r in got if r.doc_id is not None and r.doc_id not in (5,))
    assert 60 < moved < 190
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_weights(spark):
    keys = spark.range(20000).withColumnRenamed("id", "key")
    n = dict(sharding.assign_shards(keys, "key", [1.0, 2.0, 5.0]).groupBy("shard").count().collect())
    assert abs(n[1] / 20000 - 0.25) < 0.02 and abs(n[2] / 20000 - 0.625) < 0.02
    both = sharding.assign_shards(sharding.assign_shards(keys, "key", [1.0, 2.0, 5.0]), "key", [1.0, 2.0, 5.0, 3.0], out="grown")
    assert both.filter((F.col("shard") != F.col("grown")) & (F.col("grown") != 3)).count() == 0


def test_draws_as_brute_force(spark):
    """Each record's shard is that with the least -ln(u) / weight, recomputed from the hash alone."""
    weights = [1.0, 2.5, 0.5, 4.0]
    df = spark.range(300).select(F.when(F.col("id") % 50 == 7, None).otherwise(F.col("id")).alias("key"))
    hashes = [F.xxhash64(F.lit(9), F.lit(k), "key").alias(f"h{k}") for k in range(len(weights))]
    for r in sharding.assign_shards(df, "key", weights, seed=9).select("key", "shard", *hashes).collect():
        u = [(((r[f"h{k}"] & (2**64 - 1)) >> 11) + 0.5) / 2**53 for k in range(len(weights))]
        assert r.shard == min(range(len(weights)), key=lambda k: -math.log(u[k]) / weights[k])
