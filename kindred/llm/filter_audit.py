"""Filter interaction audit: packed bitmap index, AND-NOT and popcount for each prefix of each filter order.

Every document gets one bit for each filter that it fails, and one for each label. `bitmap_index` packs these bits for
the rows of each Arrow batch: sorted by part, every part padded to whole bytes, so that a part's bitmap is its own run
of bytes. `prefix_counts` reads the index: for each set of filters that ran before (32 sets of five filters) and each
filter that runs next, the bits of the next AND NOT those of the set are counted. Only counts leave a task; they are
summed over partitions, and each of the 120 orders looks its five steps up in the (set, next) sums.

Scale: one pass over the texts; what is shuffled is a 32-byte hash, an id and a few bits a row. Texts are compared by
SHA-256. Hot texts are met by a broadcast of bounded size (see common.join_groups). Counts are parts x 80 rows a task.

Nulls: a null text is empty; a null source is the part ""; a null doc_id is smaller than none and none is smaller than
it, so only ids that are given make a later copy redundant; labels are joined by doc_id, and of several labels of one
id any 1 counts; a null label counts as 0. Rows that repeat a doc_id are rows of their own. An empty table gives no
rows. Other columns are not read. Ties cannot arise: equal ids with equal texts fail no `E`, as neither is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import join_groups, load, materialize, words_of

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
_INDEX = "part string, n_rows long, " + ", ".join(f"{c} binary" for c in (*FILTERS, *LABELS))
_COUNTS = "part string, before int, next int, total long, before_fails long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a boolean column for each filter (the document fails it) and label; a row for each document."""
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of("text"))
    n, chars = F.size("words"), F.length("text").cast("long")
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"),
        (n < 200).alias("A"),
        (F.size(F.array_distinct("words")).cast("long") * 100 < n.cast("long") * 50).alias("B"),
        ((chars - F.length(F.regexp_replace("text", "[A-Z]+", ""))) * 100 > chars * 2).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = materialize(rows, "filtered")
    groups = materialize(rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "texts")
    out = join_groups(rows, groups, "hash", "n", rows.count()).withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    out = out.join(marks, "doc_id", "left")
    return out.select("part", *FILTERS, *[(F.coalesce(F.col(c), F.lit(0)) == 1).alias(c) for c in LABELS])


def bitmap_index(rows: DataFrame) -> DataFrame:
    """part, n_rows and a bitmap a filter and label: a row for each part of each Arrow batch of rows."""
    names = [*FILTERS, *LABELS]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            order, sizes = np.argsort(code, kind="stable"), np.bincount(code)
            width = (sizes + 7) // 8
            # Bit i of a part goes behind the whole bytes of the parts before it.
            place = np.arange(len(code)) + np.repeat(np.cumsum(width) * 8 - width * 8 - (np.cumsum(sizes) - sizes), sizes)
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
            columns = []
            for name in names:
                bits = np.zeros(int(width.sum()) * 8, np.uint8)
                bits[place] = batch.column(name).to_numpy(zero_copy_only=False)[order]
                columns.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(np.packbits(bits))]))
            yield pa.RecordBatch.from_arrays([parts.dictionary, pa.array(sizes, pa.int64()), *columns], ["part", "n_rows", *names])

    return rows.select("part", *names).mapInArrow(packed, _INDEX)


def prefix_counts(index: DataFrame) -> DataFrame:
    """part, before (a set of filters as bits), next (a filter's number) and their counts, summed over the index."""
    sets = [(before, f) for before in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not before >> f & 1]
    measures = ("total", "before_fails", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            sums = np.stack(list(held.values()))
            columns = [pa.array(np.repeat(np.array(list(held), object), len(sets)), pa.string())]
            columns += [pa.array(np.tile(np.array([s[i] for s in sets], np.int32), len(held))) for i in (0, 1)]
            columns += [pa.array(sums[:, :, i].ravel()) for i in range(len(measures))]
            return pa.RecordBatch.from_arrays(columns, ["part", "before", "next", *measures])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits, starts = {}, None
            for name in (*FILTERS, *LABELS):
                column = batch.column(name)
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                bits[name] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                starts = ends[:-1] - ends[0]
            count = lambda x: np.add.reduceat(np.bitwise_count(x), starts, dtype=np.int64)
            fails = [bits[f] for f in FILTERS]
            union = [np.zeros_like(fails[0])]
            for before in range(1, 1 << len(FILTERS)):
                low = (before & -before).bit_length() - 1
                union.append(union[before & before - 1] | fails[low])
            everything = (1 << len(FILTERS)) - 1
            unique = [count(x & ~union[everything & ~(1 << f)]) for f, x in enumerate(fails)]
            failed = [count(u) for u in union]
            total = batch.column("n_rows").to_numpy()
            found = np.empty((batch.num_rows, len(sets), len(measures)), np.int64)
            for i, (before, f) in enumerate(sets):
                new = fails[f] & ~union[before]
                values = (total, failed[before], count(new), count(fails[f] & union[before]), unique[f], count(new & bits["good"]), count(new & bits["toxic"]))
                for k, v in enumerate(values):
                    found[:, i, k] = v
            for part, row in zip(batch.column("part").to_pylist(), found, strict=True):
                held[part] = held[part] + row if part in held else row.copy()
            if len(held) > 2000:
                yield handed()
                held = {}
        if held:
            yield handed()

    return index.mapInArrow(counted, _COUNTS).groupBy("part", "before", "next").agg(*[F.sum(m).alias(m) for m in measures])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, for each part; see the module."""
    counts = materialize(prefix_counts(bitmap_index(failures(docs, labels))), "prefixes")
    spark, n = docs.sparkSession, len(FILTERS)
    steps = []
    for order in permutations(range(n)):
        for i, f in enumerate(order):
            steps.append(("".join(FILTERS[k] for k in order), i + 1, sum(1 << k for k in order[:i]), f))
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, next int")
    size = F.bit_count("before")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    shapley = counts.groupBy("part", "next").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    out = counts.join(shapley, ["part", "next"]).join(F.broadcast(orders), ["before", "next"])
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("before_fails") - F.col("removed")).alias("kept"),
        "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LETTERS = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
#: Failures as bits, counted for each part, then looked up in every order.
ORACLE = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
bits AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first_id, false)::INT AS b
  FROM texts JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, b, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY part, b),
letters AS (SELECT * FROM (VALUES {_LETTERS}) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s AS step, (SELECT bit FROM letters WHERE letter = filter_order[s]) AS bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))), 0)::BIGINT AS before FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE b & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE b & bit <> 0 AND b & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE b & bit <> 0 AND b & before <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE b = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE b & bit <> 0 AND b & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE b & bit <> 0 AND b & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
