"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

A document is contaminated by a benchmark item if some window of as many words as the item (the whole
text where that has fewer) has a weighted Jaccard similarity of `similarity` or more with it, over shingles of five words (an item with
fewer words is one shingle), lower-cased; a shingle's weight is how often it stands there.

1. Windows. A window as similar as that shares at least 2s/(1+s) of the item's weight, so of any
   floor(W (1-s)/(1+s)) + 1 shingles of an item it holds one at least. A shorter text shares at least s of
   it and holds one of any floor(W (1-s)) + 1. Those `anchors` are looked for at every word of every
   document, inside the row, without a shuffle, in one scan for all shingle widths; where a benchmark has
   more than INLINE_ANCHORS of them, in as many scans as it takes. Where an anchor stands, all windows of the
   sizes of its items that hold it are cut out, in whatever order they have the item's parts; a text shorter
   than the item is its own window. Windows with equal words are one from here on, so a passage that a
   third of all documents hold is worked on once.
2. SimHash. Windows and items get a 64-bit fingerprint of their shingles.
3. Hamming blocks. Fingerprints are cut into BLOCKS blocks. Two within `radius` bits differ in at most
   radius // BLOCKS bits in one block at least, so an item stands in the index at every value that near to its
   own, and one equi-join of windows and items of a size on block and value gives all pairs within the
   radius. For the default of 15 these are 697 values for each of four blocks of 16 bits, and a random pair
   meets with a chance of 4 %. Keys alone go through this join.
4. The exact similarity of the pairs within the radius decides, and nothing else does.

At a similarity of exactly 0.8 fingerprints differ in 9 bits on average, with a deviation of 3, so the radius
holds 98 of 100 such pairs, and all but all of more similar ones; README.md has the measured recall.

Only DataFrame functions are used. Nulls and blank texts hold no words and are never contaminated; null
doc_ids and repeated rows are kept apart by their text, and rows equal in both share their fate; items without
words match nothing, repeated items count once. Very long texts are one row like others; only their windows are
copied. Empty tables give empty results. Columns beside those named pass through, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import SPACE_CLASS, identity, materialize

#: Anchors that one scan tests inside the row, as a set in each task.
INLINE_ANCHORS = 200_000
BLOCKS = 4


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE_CLASS), lambda w: w != "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hash(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(width)])


def _shingle_hashes(words: Column, width: int) -> Column:
    return _let(_hashed(words), lambda h: F.transform(_positions(F.size(h), width), lambda i: _shingle_hash(h, i, width)))


def _positions(n: Column, width: int) -> Column:
    """0 .. n - width, or no position."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _shingles(words: Column, width: int) -> Column:
    """The shingles of a sequence as texts, repeats included."""
    return F.transform(_positions(F.size(words), width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def simhash(shingles: Column) -> Column:
    """64-bit majority of the shingles' XXH64 values; a tie is 0. Up to two million shingles."""
    lanes = F.lit(1 | 1 << 21 | 1 << 42).cast("long")

    def votes(hashes: Column, k: int) -> Column:
        # Bits k, k + 21 and k + 42 are counted in three 21-bit lanes of one long; bit 63 on its own.
        mask = lanes if k < 21 else F.lit(1).cast("long")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, k).bitwiseAND(mask))

    def bits(hashes: Column) -> Column:
        # Adding 2^20 - 1 - half sets a lane's highest bit where more than half voted.
        lift = (F.lit((1 << 20) - 1) - F.floor(F.size(hashes) / 2)).cast("long")
        won = [F.shiftleft(F.shiftrightunsigned(votes(hashes, k) + lift * lanes, 20).bitwiseAND(lanes), k) for k in range(21)]
        won.append(F.shiftleft(F.shiftrightunsigned(votes(hashes, 63) + lift, 20), 63))
        return functools.reduce(lambda x, y: x.bitwiseOR(y), won)

    return _let(F.transform(shingles, lambda s: F.xxhash64(s)), bits)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater weights of two shingle lists; 0 if both are empty."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    both = F.array_intersect(a, b)
    # Shingles that stand once on both sides, as most do, weigh 1; only lists with repeats are counted one by one.
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    weighed = F.aggregate(both, F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s)))
    shared = F.when(single, F.size(both)).otherwise(weighed)
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def _items(bench: DataFrame) -> DataFrame:
    """item_id, words, n, width of the items that have words; repeated items once."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("words")).distinct()
    return items.withColumn("n", F.size("words")).filter("n > 0").withColumn("width", F.least(F.col("n"), F.lit(5)))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """width, s (hash), n, core of each anchor shingle; texts of n words or more need those of the core only."""
    found = []
    missing = lambda share: F.floor((F.col("n") - F.col("width") + 1) * F.lit(share) + F.lit(1e-9)).cast("int")
    for width in range(1, 6):
        found.append(items.filter(F.col("width") == width).select(
            "item_id", "words", "n", "width", missing((1 - similarity) / (1 + similarity)).alias("slack"), missing(1 - similarity).alias("short"), F.explode(_shingle_hashes(F.col("words"), width)).alias("s")
        ))
    # Of an item's distinct shingles those with the least hashes; items are short, so a window is small.
    rank = F.dense_rank().over(Window.partitionBy("item_id", "words").orderBy("s"))
    places = functools.reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= F.col("short") + 1)
    return places.groupBy("width", "s", "n").agg(F.max(F.col("rank") <= F.col("slack") + 1).alias("core"))


def _hits(words: Column, anchors: dict[int, list[int]]) -> Column:
    """pos, width, s of the anchors in a text."""
    def of_width(h: Column, width: int) -> Column:
        at = F.filter(_positions(F.size(h), width), lambda i: _shingle_hash(h, i, width).isin(anchors[width]))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), _shingle_hash(h, i, width).alias("s")))

    return _let(_hashed(words), lambda h: F.concat(*[of_width(h, w) for w in sorted(anchors)]))


def _windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, width, n, start, window of all windows that hold an anchor; n is the items' size. docs has id and text."""
    words = words_of("text")
    anchors = materialize(anchors, "anchors")
    scans = -(-anchors.select("width", "s").distinct().count() // INLINE_ANCHORS)
    found = []
    for scan in range(scans):
        own = anchors.filter(F.pmod(F.xxhash64("s", F.lit(scans)), F.lit(scans)) == scan)
        sets: dict[int, list[int]] = {}
        for row in own.select("width", "s").distinct().collect():  # about INLINE_ANCHORS rows, dealt by hash
            sets.setdefault(row.width, []).append(row.s)
        if sets:
            hits = docs.select("id", "text", _hits(words, sets).alias("hits")).filter(F.size("hits") > 0)
            hits = hits.select("id", words.alias("words"), F.explode("hits").alias("hit")).select("id", "words", "hit.pos", "hit.width", "hit.s")
            found.append(hits.join(own, ["width", "s"]))
    if not found:
        return docs.select("id", F.lit(5).alias("width"), F.lit(0).alias("n"), F.lit(0).alias("start"), words.alias("window")).limit(0)
    places = functools.reduce(DataFrame.unionByName, found)
    size, whole = F.size("words"), F.size("words") < F.col("n")
    low = F.when(whole, 0).otherwise(F.greatest(F.col("pos") - F.col("n") + F.col("width"), F.lit(0)))
    high = F.when(whole, 0).otherwise(F.least(F.col("pos"), size - F.col("n")))
    # The words around the anchor, so that the rows of its windows are small.
    near = places.filter(F.col("core") | whole).select("id", "width", "n", low.alias("low"), high.alias("high"), F.slice("words", low + 1, high - low + F.col("n")).alias("near"))
    windows = near.select("id", "width", "n", "low", "near", F.explode(F.sequence("low", "high")).alias("start"))
    return windows.select("id", "width", "n", "start", F.slice("near", F.col("start") - F.col("low") + 1, F.col("n")).alias("window"))


def _neighbours(values: Column, width: int) -> Column:
    """Values of width bits, and all that differ from one of them in one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(flips, lambda b: v.bitwiseXOR(b)))))


def _numbered(values: Column, block: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(block).alias("block"), v.alias("value")))


def _block_values(fp: Column, near: int = 0) -> Column:
    """block, value of a fingerprint's blocks; with near, of all values that differ in up to so many bits."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    parts = []
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        values = F.array(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")))
        for _ in range(near):
            values = _neighbours(values, z - a)
        parts.append(_numbered(values, k))
    return F.concat(*parts)


def _candidates(kinds: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """key, item_id, differing_bits of all windows and items of a size within radius. kinds: key, n, fp; items: item_id, item, n, item_fp."""
    left = kinds.select("key", "n", "fp", F.explode(_block_values(F.col("fp"))).alias("b")).select("key", "n", "fp", "b.block", "b.value")
    right = items.select("item_id", "item", "n", "item_fp", F.explode(_block_values(F.col("item_fp"), radius // BLOCKS)).alias("b"))
    # The index has thousands of rows an item, which size estimates do not see: it is never broadcast.
    met = left.join(right.select("item_id", "item", "n", "item_fp", "b.block", "b.value").hint("merge"), ["n", "block", "value"])
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int")
    return met.select("key", "item_id", "item", bits.alias("differing_bits")).filter(F.col("differing_bits") <= radius).distinct()


def _matches(docs: DataFrame, bench: DataFrame, similarity: float, radius: int) -> DataFrame:
    """id, item_id, start, n_words, differing_bits, similarity: the most similar window of each pair. docs has id and text."""
    items = _items(bench)
    windows = _windows(docs, _anchors(items, similarity))
    key = F.sha2(F.concat_ws(" ", F.col("n").cast("string"), F.col("width").cast("string"), "window"), 256)
    windows = materialize(windows.withColumn("key", F.unhex(key)).distinct(), "windows")
    shingled = lambda words: F.when(F.col("width") == 5, _shingles(words, 5)).otherwise(functools.reduce(lambda e, w: e.when(F.col("width") == w, _shingles(words, w)), range(2, 5), F.when(F.col("width") == 1, words)))
    kinds = windows.groupBy("key").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.first("window").alias("window"))
    kinds = materialize(kinds.withColumn("fp", simhash(shingled(F.col("window")))), "kinds")
    # Repeated items with different words stay apart by their words.
    items = items.select("item_id", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)).alias("item"), "n", shingled(F.col("words")).alias("wanted"))
    pairs = _candidates(kinds.select("key", "n", "fp"), items.select("item_id", "item", "n", simhash(F.col("wanted")).alias("item_fp")), radius)
    pairs = pairs.join(kinds.select("key", "width", "window"), "key").join(items.select("item_id", "item", "wanted"), ["item_id", "item"])
    pairs = pairs.select("key", "item_id", F.size("window").alias("held"), "differing_bits", shingled(F.col("window")).alias("shingles"), "wanted")
    pairs = pairs.select("key", "item_id", "held", "differing_bits", weighted_jaccard(F.col("shingles"), F.col("wanted")).alias("similarity")).filter(F.col("similarity") >= similarity - 1e-9)
    # As each window's own row meets only the items it matches, the join cannot make pairs of documents.
    best = windows.select("id", "start", "key").join(pairs, "key").groupBy("id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("at"), F.col("held"), F.col("differing_bits"))).alias("w")
    )
    return best.select("id", "item_id", (-F.col("w.at")).alias("start"), F.col("w.held").alias("n_words"), "w.differing_bits", F.round("w.similarity", 6).alias("similarity"))


def contaminated(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """doc_id, item_id, start, n_words, differing_bits, similarity: the most similar window of each pair."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return _matches(rows, bench, similarity, radius).withColumnRenamed("id", "doc_id")


def clean_documents(docs: DataFrame, bench: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """Rows of docs, all columns, that no benchmark item contaminates."""
    # Rows are told apart by doc_id and text; they travel as one column, so that no name can clash.
    who = identity("doc_id", "text")
    bad = _matches(docs.select(who.alias("id"), "text"), bench, similarity, radius).select("id").distinct()
    rows = docs.select(who.alias("id"), F.struct("*").alias("row"))
    return rows.join(bad, "id", "left_anti").select("row.*")
