"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its words (lower-cased, hashed to `2**bits` places, weighted by
1 + ln(count), length 1 in all) and one place for each statistic of its structure and metadata, which
is cut into bins. score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), and the pair sum is
half of (sum v_i x_i)^2 - sum (v_i x_i)^2, so scoring takes time in proportion to the words.

The model is fitted on a bounded sample of labelled rows: the `train_rows` (default 8,000) rows
with the least hash of their doc_id among those that may be learnt from, of rows of one doc_id the one
with the least text hash. It has a fixed size
(2**bits + statistics places of 1 + rank numbers, 0.6 MB) whatever the corpus is, so it goes to the executors
with the function. Everything is scored.

doc_id, lang, source and labels are never inputs of a score. Metadata is the table's n_chars.
Nulls: a null text is empty and gets a score like any other; a missing or null n_chars has its own bin;
labels with a null doc_id or quality are not learnt from, and of repeated labels the mean counts.
Without any labels all scores are 0.5. Repeated rows repeat their scores; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 16
_KINDS = np.zeros((256, 7), dtype=np.float64)  # lower, upper, digit, blank, line end, ASCII mark, beyond ASCII
_KINDS[97:123, 0] = _KINDS[65:91, 1] = _KINDS[48:58, 2] = 1
_KINDS[[32, 9, 11, 12, 13], 3] = _KINDS[10, 4] = 1
_KINDS[128:, 6] = 1
_KINDS[_KINDS.sum(1) == 0, 5] = 1
STATISTICS = 14


def statistics(data: bytes, words: list[bytes], distinct: int, n_chars: int | None) -> list[float]:
    """Values from 0 to 1."""
    n, k = max(1, len(data)), max(1, len(words))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digit, blank, line, mark, beyond = (counts @ _KINDS).tolist()
    marks = counts[:128] * _KINDS[:128, 5]
    lines = data.split(b"\n")
    return [
        math.log1p(len(words)) / 14, math.log1p(len(data)) / 20, min(1.0, len(data) / k / 16),
        upper / max(1.0, upper + lower), min(1.0, 4 * digit / n), min(1.0, 3 * blank / n), min(1.0, 20 * line / n),
        min(1.0, 3 * mark / n), min(1.0, mark / k / 4), float(marks.max()) / max(1.0, float(marks.sum())),
        beyond / n, distinct / k, len(set(lines)) / len(lines),
        0.0 if n_chars is None else min(1.0, (1 + math.log1p(max(0, n_chars))) / 20),
    ]


def features(data: bytes, n_chars: int | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; each place once."""
    words = data.lower().split()
    counts = Counter(words)
    place = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & ((1 << bits) - 1)
    count = np.fromiter(counts.values(), np.float64, len(counts))
    if len(place):
        place, inverse = np.unique(place, return_inverse=True)
        value = 1 + np.log(np.bincount(inverse, weights=count))
        value /= math.sqrt(float(value @ value))
    else:
        value = count
    stats = np.minimum((np.array(statistics(data, words, len(counts), n_chars)) * BINS).astype(np.int64), BINS - 1)
    stats += (1 << bits) + BINS * np.arange(STATISTICS)
    return np.concatenate([place, stats]), np.concatenate([value, np.full(STATISTICS, 0.5)])


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    bits: int

    def score(self, place: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[place] * value[:, None]
        total = vx.sum(0)
        z = self.bias + float(self.weight[place] @ value) + 0.5 * float((total * total).sum() - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = 14, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 0) -> Model:
    """AdaGrad on the log loss, in batches of 64 rows."""
    size = (1 << bits) + BINS * STATISTICS
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.01, (size, rank)), bits)
    if not rows:
        model.factors[:] = 0
        return model
    mean = min(1 - 1e-3, max(1e-3, float(np.mean([y for *_, y in rows]))))
    model.bias = math.log(mean / (1 - mean))
    seen = np.full((size, rank + 1), 1e-6)
    for _ in range(epochs):
        turn = rng.permutation(len(rows))
        for a in range(0, len(turn), 64):
            batch = [rows[i] for i in turn[a : a + 64]]
            y = np.array([r[2] for r in batch])
            sizes = np.array([len(r[0]) for r in batch])
            place, value = np.concatenate([r[0] for r in batch]), np.concatenate([r[1] for r in batch])
            first, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(batch)), sizes)
            vx = model.factors[place] * value[:, None]
            total = np.add.reduceat(vx, first)
            z = model.bias + np.add.reduceat(model.weight[place] * value, first) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            model.bias -= 0.05 * float(g.mean())
            gx = g[row] * value
            used, inverse = np.unique(place, return_inverse=True)
            grad = np.stack([np.bincount(inverse, weights=c) for c in (gx, *(gx[:, None] * (total[row] - vx)).T)], 1) / len(batch)
            grad[:, 0] += decay * model.weight[used]
            grad[:, 1:] += decay * model.factors[used]
            seen[used] += grad * grad
            step = rate * grad / np.sqrt(seen[used])
            model.weight[used] -= step[:, 0]
            model.factors[used] -= 0.3 * step[:, 1:]
    return model


def bucket(doc_id, of: int = 5):
    """CRC-32 of doc_id as text, modulo `of`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def training_rows(docs: DataFrame, labels: DataFrame, bits: int, train_rows: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Features and labels of the bounded sample; rows of bucket 0 are held out."""
    known = labels.filter("doc_id is not null and quality is not null").filter(bucket(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    # One row an id, so that the bound holds for rows: that with the least text hash.
    joined = _inputs(docs).join(F.broadcast(chosen), F.col("key") == F.col("id"))
    least = F.struct(F.xxhash64("data").alias("hash"), F.col("data"), F.col("n_chars"))
    texts = joined.groupBy("key", "y").agg(F.min(least).alias("least")).select("key", "least.data", "least.n_chars", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data, chars, y = (batch.column(i) for i in range(4))
            found = [features(d, c, bits) for d, c in zip(data.to_pylist(), chars.to_pylist(), strict=True)]
            place = [p.astype("<i4").tobytes() for p, _ in found]
            value = [v.astype("<f4").tobytes() for _, v in found]
            yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.binary()), pa.array(value, pa.binary()), y], names=["key", "place", "value", "y"])

    rows = texts.mapInArrow(run, "key long, place binary, value binary, y double").collect()
    rows.sort(key=lambda r: (r.key, bytes(r.place), bytes(r.value)))
    return [(np.frombuffer(r.place, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(np.float64), r.y) for r in rows]


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, bits: int = 14, train_rows: int = 8000) -> Model:
    return fit(training_rows(docs, labels, bits, train_rows), bits)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = _inputs(docs).mapInArrow(_scorer_of(model), "key long, score double")
    return scored.select(
        F.col("key").alias("doc_id"), F.coalesce(bucket(F.col("key")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _scorer_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(*features(d.as_buffer().to_pybytes(), n, model.bits)) for d, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    return run


def keep_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of docs, all columns, whose score is at least threshold; a null in text counts as empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, bits = docs.schema, model.bits
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(chars).to_pylist() if chars is not None else [None] * batch.num_rows
            keep = [model.score(*features((t.as_py() or "").encode(), c, bits)) >= threshold for t, c in zip(batch.column(text), n, strict=True)]
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out.columns, schema=arrow)

    return docs.mapInArrow(run, schema)
