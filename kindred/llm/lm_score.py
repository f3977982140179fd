"""LM scoring by cross-entropy difference: target and background word n-gram models over one vocabulary.

Tokens are lower-cased words. The vocabulary is that of the whole corpus, every word of every document, and
both models spread their probability over it. They are bigram models interpolated with unigrams
(Witten-Bell), with counts from whole texts: the background from every document, the target from those that
`labels` marks as good and not toxic. A token's score is its background loss minus its target loss, in
bits, and a text's score is the mean over its tokens: the higher, the more it looks like the target.

A bigram joins two classes. The `top` most frequent words (65,536) are classes of their own, all other words
share one, and a text's first word stands behind a class for the start; a word of the shared class has that
class's chance times its share of the class's unigrams. So every token of every text is counted and scored as
a bigram, what stands behind a word adds up to how often something does, and both models' chances add up to one.

Unigrams are a table with a row for each word and bigrams one with a row for each pair met, as long as the corpus
has them. What tasks get as broadcasts is of fixed size and saves work only: the top words with their totals; the
most frequent pairs, up to `pairs` of them (4,194,304, 50 MB); and, where more pairs stand more than once, a
bit map of these (2^28 bits). A token whose pair is in neither is that pair's one token in the corpus, whose
score needs no table. Other pairs, and words of the shared class, meet their tables in a join: none of them is more than
one in `pairs`, or `top`, of all tokens, so no key of these joins is hot.

Words are counted in Arrow batches, some million code points at a time; sums are integers (millionths of
a bit), so that a score does not hang on the order of the work.

Nulls: a null, empty or blank text has no tokens and scores 0. Labels with a null doc_id, quality or toxic
mark nothing; of repeated labels the least good holds. Without target documents all scores are 0. Repeated
rows count as often as they stand, and repeat their scores; rows with a null doc_id are scored like others.
An empty table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize

TOP = 1 << 16
PAIRS = 1 << 22
#: Bytes of text that a task counts, or scores, at a time: counts of more text are fewer rows, scores take more memory.
SLICE, SCORED = 1 << 24, 1 << 22
#: Labelled ids up to this number are broadcast (8 MB), more are joined by a shuffle.
IDS = 1 << 20
UNIT = 1_000_000
#: A prime of bits, in rows of 32,768 of them, and what a pair's classes count in them.
BITS, BIT_ROW, BY_FIRST, BY_SECOND = 268_435_399, 32_768, 2_654_435_761, 2_246_822_519


def _slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows, about most bytes of text at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(edges, edges[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and word number of every word, and the words by number."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    number, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
    # Blanks at a text's ends give empty words.
    empty = pc.index(words, pa.scalar("")).as_py()
    if empty >= 0:
        there = number != empty
        row, number = row[there], number[there]
    return row, number, words


def _rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, good: whether labels marks the document as one of the target."""
    good = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    good = materialize(good.agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).filter("good").select("id", "good"), "target")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = good.count() <= IDS
    return rows.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, n, t: how often each word stands in all texts, and in those of the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, SLICE):
                row, number, words = _words(part.column(1))
                good = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                n = np.bincount(number, minlength=len(words))
                t = np.bincount(number[good[row]], minlength=len(words))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(n[at]), pa.array(t[at])], names=["word", "n", "t"])

    return rows.mapInArrow(run, "word string, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _classes(words: pa.Array, known: pa.Array, row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and of the one before it: a place in known, then that of all other words, then the start."""
    own = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy().astype(np.int64)[number]
    first = np.full(len(own), len(known) + 1)
    first[1:] = np.where(row[1:] == row[:-1], own[:-1], len(known) + 1)
    return first, own


def _pair_counts(rows: DataFrame, known: pa.Array) -> DataFrame:
    """code (first << 32 | second), n, t of the pairs of neighbouring classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, SLICE):
                row, number, words = _words(part.column(1))
                good = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                first, own = _classes(words, known, row, number)
                kinds, count = np.unique(first << 33 | own << 1 | good[row], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds >> 1), pa.array(count), pa.array(count * (kinds & 1))], names=["code", "n", "t"])

    return rows.mapInArrow(run, "code long, n long, t long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _rank(n: Column) -> Column:
    return F.floor(F.log2(n) * 16).cast("int")


def _least_rank(counts: DataFrame, most: int) -> int:
    """The least rank of counts from which on there are no more than most rows."""
    sizes = sorted((r.r, r["count"]) for r in counts.groupBy(_rank(F.col("n")).alias("r")).count().collect())  # 1,024 ranks at most
    total, least = 0, sizes[-1][0] + 1 if sizes else 0
    for r, size in reversed(sizes):
        total += size
        if total > most:
            break
        least = r
    return least


#: What is known of a class: its unigram chance (p), and how many kinds, and tokens and kinds, stand behind it, in both models.
_CLASS = ("p_b", "p_t", "kinds_b", "all_b", "kinds_t", "all_t")


def _chance(count, kinds, total, p, where):
    return where(total > 0, (count + kinds * p) / where(total > 0, total, 1.0), p)


def _gain(n, t, first, second, where, log2):
    """Target's log chance less the background's, of a pair with counts n and t; first, second: what is known of its classes, by name."""
    target = _chance(t, first("kinds_t"), first("all_t"), second("p_t"), where)
    return log2(target) - log2(_chance(n, first("kinds_b"), first("all_b"), second("p_b"), where))


@dataclass
class Model:
    """Both models' loss differences; gains are in UNITs of a bit."""

    words: pa.Array
    classes: dict[str, np.ndarray]
    codes: np.ndarray  # the most frequent pairs, sorted
    gains: np.ndarray
    bits: np.ndarray | None  # of the pairs in `others`
    others: DataFrame  # code, if_good, if_not: what other pairs' gains add to that of a pair met once, in the target or not
    pairs: DataFrame  # code, n, t of every pair
    vocabulary: DataFrame  # word, gain: what a word of the shared class adds to its class's gain


def _bit_map(others: DataFrame) -> np.ndarray:
    """Bits of the pairs in others: 8,192 rows of 4 KB."""
    place = F.pmod(F.shiftright("code", 32) * BY_FIRST + F.col("code").bitwiseAND(F.lit((1 << 32) - 1)) * BY_SECOND, F.lit(BITS))
    rows = others.select(F.floor(place / BIT_ROW).cast("int").alias("row"), (place % BIT_ROW).alias("bit")).repartition("row")
    found = rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bits = np.zeros((BITS // BIT_ROW + 1, BIT_ROW // 8), np.uint8)
    for row, own in zip(found.column("row").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[row] = np.frombuffer(own, np.uint8)
    return bits.ravel()


def _in_bits(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    place = (first * BY_FIRST + second * BY_SECOND) % BITS
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _known_classes(counts: DataFrame, size, found: pa.Table, pairs: DataFrame) -> dict[str, np.ndarray]:
    """_CLASS by class: the top words, all other words, the start."""
    n, t = (np.append(found.column(c).to_numpy(), 0).astype(float) for c in ("n", "t"))
    kinds = np.ones(len(n))
    n[-1], t[-1], kinds[-1] = size.n - n.sum(), size.t - t.sum(), size.kinds - found.num_rows
    if not kinds[-1]:  # no class of other words, and no token of it
        kinds[-1] = 1
    out = {"p_b": (n + kinds) / (size.n + size.kinds), "p_t": (t + kinds * (size.target / size.kinds)) / (size.t + size.target)}
    out = {c: np.append(p, 1.0) for c, p in out.items()}
    first = F.shiftright("code", 32).alias("first")
    seen = F.col("t") > 0
    behind = pairs.groupBy(first).agg(F.count(F.lit(1)).alias("kinds_b"), F.sum("n").alias("all_b"), F.count_if(seen).alias("kinds_t"), F.sum("t").alias("all_t")).toArrow()
    for c in _CLASS[2:]:
        out[c] = np.zeros(len(n) + 1)
        out[c][behind.column("first").to_numpy()] = behind.column(c).to_numpy()
    out["all_b"], out["all_t"] = out["all_b"] + out["kinds_b"], out["all_t"] + out["kinds_t"]
    return out


def train(rows: DataFrame, top: int = TOP, pairs: int = PAIRS) -> Model | None:
    """Both models, from all rows (doc_id, text, good); nothing without a target."""
    spark = rows.sparkSession
    counts = materialize(_word_counts(rows), "words")
    size = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count_if(F.col("t") > 0).alias("target")).first()
    if not size.t:
        return None
    found = counts.orderBy(F.desc("n"), "word").limit(top).toArrow()  # 65,536 rows
    words = found.column("word").combine_chunks().cast(pa.string())
    met = materialize(_pair_counts(rows, words), "pairs")
    known = _known_classes(counts, size, found, met)

    # A row for each class, of a fixed number, joined as a broadcast.
    table = spark.createDataFrame(pa.table({"class": np.arange(len(words) + 2), **known}))
    first, second = (F.broadcast(table.select(*[F.col(c).alias(f"{side}_{c}") for c in table.columns])) for side in ("first", "second"))
    repeated = met.filter("n > 1")
    joined = repeated.join(first, F.shiftright("code", 32) == F.col("first_class")).join(second, F.col("code").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("second_class"))

    def gain(n: Column, t: Column) -> Column:
        where = lambda test, yes, no: F.when(test, yes).otherwise(no)
        bits = _gain(n, t, lambda c: F.col(f"first_{c}"), lambda c: F.col(f"second_{c}"), where, F.log2)
        return F.round(bits * UNIT).cast("long")

    one, none = F.lit(1), F.lit(0)
    own = gain(F.col("n"), F.col("t"))
    least = _least_rank(repeated, pairs)
    kept = joined.filter(_rank(F.col("n")) >= least).select("code", own.alias("gain")).toArrow()  # 4,194,304 rows of 16 bytes
    codes, gains = (kept.column(c).to_numpy() for c in ("code", "gain"))
    order = np.argsort(codes)
    others = joined.filter(_rank(F.col("n")) < least).select("code", (own - gain(one, one)).alias("if_good"), (own - gain(one, none)).alias("if_not"))
    bits = _bit_map(others.select("code")) if repeated.filter(_rank(F.col("n")) < least).limit(1).count() else None

    share = F.log2((F.col("t") + size.target / size.kinds) / (size.t + size.target)) - F.log2((F.col("n") + 1) / (size.n + size.kinds))
    of_class = np.log2(known["p_t"][len(words)]) - np.log2(known["p_b"][len(words)])
    vocabulary = counts.select("word", F.round((share - float(of_class)) * UNIT).cast("long").alias("gain"))
    return Model(words, known, codes[order], gains[order].astype(np.int32), bits, others, met, vocabulary)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_tokens, score of every row of those that the model counts."""
    shared = rows.sparkSession.sparkContext.broadcast((model.words, model.classes, model.codes, model.gains, model.bits) if model else None)
    fields = "doc_id long, n_tokens long, sum long, good boolean, rest array<string>, others array<long>"

    def lists(kind: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, SCORED):
                row, number, words = _words(part.column(1))
                length = np.bincount(row, minlength=part.num_rows)
                ends = np.cumsum(length)
                gain = np.zeros(len(row), np.int64)
                rest = others = np.zeros(0, np.int64)
                code = np.zeros(len(row), np.int64)
                if shared.value:
                    known, classes, codes, gains, bits = shared.value
                    first, own = _classes(words, known, row, number)
                    rest = np.flatnonzero(own == len(known))
                    code = first << 32 | own
                    # Each pair of the slice is looked up once.
                    kinds, back = np.unique(code, return_inverse=True)
                    at = np.minimum(np.searchsorted(codes, kinds), max(len(codes) - 1, 0))
                    hit = codes[at] == kinds if len(codes) else np.zeros(len(kinds), bool)
                    by_kind = np.where(hit, gains[at] if len(codes) else 0, 0)
                    gain = by_kind[back]
                    miss = np.flatnonzero(~hit[back])
                    # As if met once; what other pairs have beside that is joined.
                    a, z = first[miss], own[miss]
                    good = part.column(2).to_numpy(zero_copy_only=False).astype(float)[row[miss]]
                    gain[miss] = np.rint(_gain(1.0, good, lambda c: classes[c][a], lambda c: classes[c][z], np.where, np.log2) * UNIT).astype(np.int64)
                    others = miss[_in_bits(bits, a, z)] if bits is not None else others
                total = np.concatenate([[0], np.cumsum(gain)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(length), pa.array(total[ends] - total[ends - length]), part.column(2),
                     lists(words.take(pa.array(number[rest])), rest, ends), lists(pa.array(code[others]), others, ends)],
                    names=["doc_id", "n_tokens", "sum", "good", "rest", "others"],
                )

    # Written once, so that row numbers hold.
    scored = materialize(rows.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    gains = F.lit(0).cast("long")
    if model:
        more = scored.select("row", F.explode("rest").alias("word")).join(model.vocabulary, "word").select("row", "gain")
        if model.bits is not None:
            pairs = scored.select("row", "good", F.explode("others").alias("code")).join(model.others, "code")
            more = more.unionByName(pairs.select("row", F.when(F.col("good"), F.col("if_good")).otherwise(F.col("if_not")).alias("gain")))
        more = more.groupBy("row").agg(F.sum("gain").alias("more"))
        scored = scored.drop("rest", "others").join(more, "row", "left")
        gains = F.coalesce("more", F.lit(0).cast("long"))
    mean = F.when(F.col("n_tokens") > 0, (F.col("sum") + gains) / F.lit(float(UNIT)) / F.col("n_tokens")).otherwise(0.0)
    return scored.select("doc_id", "n_tokens", F.round(mean, 6).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    rows = _rows(docs, labels)
    return score(rows, train(rows, top, pairs))


#: Classes are numbered by frequency; 65,537 is that of all other words, 0 the start.
ORACLE = r"""
WITH good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
  GROUP BY doc_id HAVING bool_and(quality = 1 AND toxic = 0)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, d.doc_id, (g.doc_id IS NOT NULL)::INT AS good,
         regexp_extract_all(lower(coalesce(d.text, '')), '[^\x20\x09-\x0D]+') AS ws
  FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id
), tokens AS (
  SELECT r, good, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs
), counts AS MATERIALIZED (
  SELECT word, count(*) AS n, sum(good) AS t, least(65537, row_number() OVER (ORDER BY count(*) DESC, word)) AS class FROM tokens GROUP BY word
), size AS (
  SELECT sum(n)::DOUBLE AS n, sum(t)::DOUBLE AS t, count(*)::DOUBLE AS kinds, count_if(t > 0)::DOUBLE AS target FROM counts
), classes AS (
  SELECT class, (sum(c.n) + count(*)) / (any_value(s.n) + any_value(s.kinds)) AS p_b,
         (sum(c.t) + count(*) * (any_value(s.target) / any_value(s.kinds))) / (any_value(s.t) + any_value(s.target)) AS p_t
  FROM counts c, size s GROUP BY class
), places AS MATERIALIZED (
  SELECT r, good, word, class, coalesce(lag(class) OVER (PARTITION BY r ORDER BY i), 0) AS first FROM tokens JOIN counts USING (word)
), pairs AS (
  SELECT first, class, count(*) AS n, sum(good) AS t FROM places GROUP BY first, class
), behind AS (
  SELECT first, count(*) AS kinds_b, sum(n) + count(*) AS all_b, count_if(t > 0) AS kinds_t, sum(t) + count_if(t > 0) AS all_t FROM pairs GROUP BY first
), pair_gains AS (
  SELECT first, class, round(1000000 * (
           log2(CASE WHEN all_t > 0 THEN (t + kinds_t * p_t) / all_t ELSE p_t END) - log2((n + kinds_b * p_b) / all_b)))::BIGINT AS gain
  FROM pairs JOIN behind USING (first) JOIN classes USING (class)
), word_gains AS (
  SELECT word, round(1000000 * (log2((c.t + s.target / s.kinds) / (s.t + s.target)) - log2((c.n + 1) / (s.n + s.kinds)) - (log2(p_t) - log2(p_b))))::BIGINT AS gain
  FROM counts c JOIN classes USING (class), size s WHERE class = 65537
), sums AS (
  SELECT r, sum(p.gain + coalesce(w.gain, 0)) AS total FROM places JOIN pair_gains p USING (first, class) LEFT JOIN word_gains w USING (word) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_tokens,
       CASE WHEN len(ws) > 0 AND (SELECT t > 0 FROM size) THEN round(total::DOUBLE / 1000000 / len(ws), 6) ELSE 0.0 END AS score
FROM docs LEFT JOIN sums USING (r)
"""
