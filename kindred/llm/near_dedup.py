"""Near-dedup by five-word shingles and an exact Jaccard similarity of 0.8, with SimHash candidates.

Digest: a text's words in lower case (A-Z), its distinct 5-word shingles (fewer words: the whole sequence), and 256
majority bits over them, as four 64-bit words. Two shingle sets with a Jaccard similarity of 0.8 differ in about 15 % of
the bits (in up to 19 % where sets are very small). Candidates share the sampled bits of one of several tables; how
many bits and tables hangs on the number of texts, so that groups stay at some hundred texts and a pair at 0.8 meets
with a chance of 0.97. Within a group the Gray-order hierarchical index of simhash.py prunes by the first word, and the
last test is on all 256 bits. What is left is compared exactly; only pairs at 0.8 or more are linked.

Two rounds keep dense groups cheap. The first takes, of each run of close fingerprints, neighbours in Gray order only: a
group of copies costs a chain. The second takes all candidates between texts that the first has not yet joined, and
passes over nodes of the index that lie within one component. Texts that have such a candidate are given a parity map:
each shingle turns one of about twice as many bits as the text has shingles. Two maps differ in no more bits than the
sets differ in shingles, so a pair whose maps differ too much is below 0.8, without doubt, and is dropped within its group,
before it is a row. Nothing is capped: the maps of a group of many texts that are all near in bits are compared pair by
pair, some hundred thousand at a time.

Texts are told apart by 128 bits of their word sequence. Nulls: a null text is an empty one; texts without words are
alike. Rows equal in key and text are copies. An empty table gives an empty one. A text's words are held at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import discard, identity, materialize, small_batches
from kindred.llm.components import components
from kindred.llm.simhash import FAN, LEAF, _levels, gray_rank, link_groups

WIDTH, SIMILARITY = 5, 0.8
#: The share of bits in which a pair at the similarity differs, and the chance to meet that tables are made for.
DIFFERING, MEETING = 0.17, 0.97
#: Most differing bits of a candidate: of all 256, of the first 64, and of the first 64 in the first round.
RADIUS, RADIUS_FIRST, RADIUS_CLOSE = 60, 21, 6
BROADCAST_ROWS = 500_000
#: What a task holds: texts of an Arrow batch, rows of whole groups without and with maps (one group at least), pairs compared at once.
TEXTS_AT_ONCE, ROWS_AT_ONCE, MAPS_AT_ONCE, PAIRS_AT_ONCE = 500, 1 << 16, 1 << 13, 1 << 17
#: Least and most bits of a parity map, as powers of two, and the bytes of maps compared at once.
MAP_LEAST, MAP_MOST, MAP_BYTES = 8, 14, 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_WORDS = ["w0", "w1", "w2", "w3"]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct shingles as 64-bit hashes, in order; the whole sequence where it is shorter, none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter((of[w] for w in words), np.uint64, len(words))
    size = min(width, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mixed(out ^ h[k : len(h) - size + 1 + k], 0)
    return np.unique(out)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x + _ODD[k]) * _ODD[(k + 1) % 4]
    x ^= x >> np.uint64(29)
    x *= _ODD[(k + 2) % 4]
    return x ^ x >> np.uint64(32)


def digest(hashes: np.ndarray) -> np.ndarray:
    """256 majority bits of shingle hashes, as four 64-bit words."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        wide = np.stack([_mixed(_mixed(part, k), k) for k in range(4)], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _prints(rows: DataFrame) -> DataFrame:
    """key, who, node, w0 .. w3 of rows (key, who, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = [], np.zeros((batch.num_rows, 4), np.uint64)
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_buffer().to_pybytes())
                nodes.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                prints[i] = digest(shingle_hashes(words))
            columns = [batch.column("key"), batch.column("who"), pa.array(nodes, pa.binary()), *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "who", "node", *_WORDS])

    binary = rows.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    return binary.mapInArrow(run, "key long, who binary, node binary, w0 long, w1 long, w2 long, w3 long")


def tables_for(count: int) -> tuple[int, int]:
    """Sampled bits and tables for so many texts."""
    bits = min(60, max(12, math.ceil(math.log2(max(2, count))) - 8))
    return bits, math.ceil(math.log(1 - MEETING) / math.log(1 - (1 - DIFFERING) ** bits))


def parity_map(hashes: np.ndarray) -> bytes:
    """Bits that are one where an odd number of the shingles falls: a power of two, twice as many as shingles or more."""
    bits = 1 << min(MAP_MOST, max(MAP_LEAST, (2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def maps_allow(sizes: np.ndarray, maps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of places, False where the maps prove a similarity below the least: a larger map is folded first.

    At 0.8 or more two sets differ in a ninth of their sizes' sum at most, and the smaller has four fifths of the larger.
    """
    both = sizes[i] + sizes[j]
    out = 10 * np.minimum(sizes[i], sizes[j]) >= 8 * np.maximum(sizes[i], sizes[j])
    width = np.fromiter(map(len, maps), np.int64, len(maps))
    least = np.minimum(width[i], width[j])
    for w in np.unique(least[out]).tolist():
        at = np.flatnonzero(out & (least == w))
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        table = np.zeros((len(used), w // 8), np.uint64)
        for row, u in enumerate(used.tolist()):
            table[row] = np.bitwise_xor.reduce(np.frombuffer(maps[u], np.uint64).reshape(-1, w // 8), axis=0)
        left, right = place[: len(at)], place[len(at) :]
        for start in range(0, len(at), step := max(1, MAP_BYTES // w)):
            part = slice(start, start + step)
            out[at[part]] = 9 * _distance(table, left[part], right[part]) <= both[at[part]]
    return out


def _banded(prints: DataFrame, count: int) -> DataFrame:
    """t, band and the columns of prints (node, label, w0 .. w3, others), a row for each table."""
    bits, tables = tables_for(count)
    draw = np.random.default_rng(20)
    chosen = [draw.choice(256, bits, replace=False) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in _WORDS]
            for t, places in enumerate(chosen):
                band = np.zeros(batch.num_rows, np.uint64)
                for p in places.tolist():
                    band = band << np.uint64(1) | words[p >> 6] >> np.uint64(p & 63) & np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(band.view(np.int64)), *batch.columns], ["t", "band", *batch.schema.names])

    return prints.mapInArrow(run, "t int, band long, " + ", ".join(f"{c} {kind}" for c, kind in prints.dtypes))


def _distance(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for column in words.T:
        out += np.bitwise_count(column[i] ^ column[j])
    return out


def close_chains(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours, in Gray order, of each component that the first word's index links closely."""
    order, label = link_groups(group, np.ascontiguousarray(words[:, 0]), RADIUS_CLOSE)
    by = np.lexsort((np.arange(len(order)), label))
    i, j = by[:-1], by[1:]
    same = label[i] == label[j]
    i, j = order[i[same]], order[j[same]]
    near = _distance(words, i, j) <= RADIUS
    return i[near], j[near]


def apart_pairs(group: np.ndarray, words: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a group within the radius whose labels differ, by the Gray-order hierarchical index, part by part."""
    order = np.lexsort((gray_rank(words[:, 0]), group))
    group, words, label = group[order], words[order], label[order]
    n = len(order)
    if not n:
        return
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    levels, starts, ends = [], edges, np.append(edges[1:], n)
    ones = ands = words[:, 0]
    low = high = label
    while True:
        a, z, count = _levels(starts, ends, FAN if levels else LEAF)
        ones, ands = np.bitwise_or.reduceat(ones, a), np.bitwise_and.reduceat(ands, a)
        low, high = np.minimum.reduceat(low, a), np.maximum.reduceat(high, a)
        levels.append({"a": a, "z": z, "mask": ~(ones ^ ands), "bits": ands, "low": low, "high": high})
        if (count == 1).all():
            break
        ends = np.cumsum(count)
        starts = ends - count
    roots = np.arange(len(levels[-1]["a"]))
    zero = np.zeros(len(roots), np.uint64)
    stack = [(len(levels) - 1, roots, roots, zero, np.zeros(len(roots), np.uint8))]
    while stack:
        depth, p, q, fixed, acc = stack.pop()
        level = levels[depth]
        if len(p) > (cut := PAIRS_AT_ONCE // (FAN * FAN)):
            stack += [(depth, p[i : i + cut], q[i : i + cut], fixed[i : i + cut], acc[i : i + cut]) for i in range(0, len(p), cut)]
            continue
        both = level["mask"][p] & level["mask"][q]
        acc = acc + np.bitwise_count((level["bits"][p] ^ level["bits"][q]) & both & ~fixed)
        one = (level["low"][p] == level["high"][p]) & (level["low"][q] == level["high"][q]) & (level["low"][p] == level["low"][q])
        go = (acc <= RADIUS_FIRST) & ~one
        p, q, both, acc = p[go], q[go], both[go], acc[go]
        if not len(p):
            continue
        nq = level["z"][q] - level["a"][q]
        total = (level["z"][p] - level["a"][p]) * nq
        inside = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nq, total)
        left, right = np.repeat(level["a"][p], total) + inside // width, np.repeat(level["a"][q], total) + inside % width
        if depth:
            ahead = left <= right
            stack.append((depth - 1, left[ahead], right[ahead], np.repeat(both, total)[ahead], np.repeat(acc, total)[ahead]))
        else:
            ahead = (left < right) & (label[left] != label[right])
            left, right = left[ahead], right[ahead]
            near = _distance(words, left, right) <= RADIUS
            yield order[left[near]], order[right[near]]


def _grouped(prints: DataFrame, count: int, of_groups, schema: str) -> DataFrame:
    """What of_groups gives for whole groups: group numbers, words, and the rows as an Arrow table."""

    most = MAPS_AT_ONCE if "map" in prints.columns else ROWS_AT_ONCE

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        t, band = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(2))
        words = np.stack([rows.column(w).combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64) for w in _WORDS], 1)
        group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (band[1:] != band[:-1])]))
        return of_groups(group, words, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size > most:
                t, band = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                edges = np.flatnonzero((t[1:] != t[:-1]) | (band[1:] != band[:-1])) + 1
                if len(edges):
                    cut = int(edges[-1])
                    yield pairs([*held[:-1], batch.slice(0, cut)])
                    held, size = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield pairs(held)

    rows = _banded(prints, count).repartition("t", "band").sortWithinPartitions("t", "band")
    return rows.mapInArrow(run, schema)


def _chained(prints: DataFrame, count: int) -> DataFrame:
    """a, b: neighbours in Gray order, the candidates of the first round."""

    def of_groups(group, words, rows):
        i, j = close_chains(group, words)
        node = rows.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    found = _grouped(prints, count, of_groups, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labels(rows: pa.Table) -> np.ndarray:
    return rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _with_candidates(labelled: DataFrame, count: int) -> DataFrame:
    """node: texts that have a candidate in another component; a row a text, however many it has."""

    def of_groups(group, words, rows):
        has = np.zeros(len(group), bool)
        for i, j in apart_pairs(group, words, _labels(rows)):
            has[i] = has[j] = True
        return pa.RecordBatch.from_arrays([rows.column("node").combine_chunks().take(pa.array(np.flatnonzero(has)))], ["node"])

    return _grouped(labelled, count, of_groups, "node binary").distinct()


def _apart(mapped: DataFrame, count: int) -> DataFrame:
    """a, b: candidates in different components that their parity maps allow to be similar enough."""

    def of_groups(group, words, rows):
        sizes, maps = rows.column("size").to_numpy(), rows.column("map").to_pylist()
        found = [(group[:0], group[:0])]
        for i, j in apart_pairs(group, words, _labels(rows)):
            kept = maps_allow(sizes, maps, i, j)
            found.append((i[kept], j[kept]))
        node = rows.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)], ["a", "b"])

    found = _grouped(mapped, count, of_groups, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_maps(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of labelled that have a set, with its size and its parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, maps = [], []
            for shingles in batch.column("shingles"):
                hashes = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sizes.append(len(hashes))
                maps.append(parity_map(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["node", "size", "map"])

    return labelled.join(sets.mapInArrow(run, "node binary, size long, map binary"), "node")


def _sets(nodes: DataFrame, rows: DataFrame, owners: DataFrame) -> DataFrame:
    """node, shingles of the nodes; rows: who and text, owners: each node and the who of one row with its text."""
    wanted = materialize(owners.join(nodes, "node", "left_semi"), "wanted")
    # 48 bytes a row; where there are more rows, texts are shuffled to them.
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(words_of(t.as_buffer().to_pybytes())).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = rows.join(near, "who").select("node", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    with small_batches(rows.sparkSession, TEXTS_AT_ONCE):
        sets = materialize(texts.mapInArrow(run, "node binary, shingles array<bigint>").dropDuplicates(["node"]), "shingles")
    discard(wanted)
    return sets


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    met = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("shingles", "x"), "a").join(sets.withColumnRenamed("node", "b").withColumnRenamed("shingles", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialize(met.filter(shared >= (F.size("x") + F.size("y") - shared) * F.lit(SIMILARITY) - 1e-9).select("a", "b"), "linked")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, all columns, of each group: that with the least key (null keys last).

    Of rows equal in key and text that with the least identity of all columns stays. Columns may have any names.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), identity(key, text).alias("who"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        prints = materialize(_prints(rows), "prints")
    best = F.struct(F.col("key").isNull().alias("none"), "key", "who")
    distinct = prints.groupBy("node").agg(F.min(best).alias("own"), *[F.min(w).alias(w) for w in _WORDS])
    distinct = materialize(distinct, "texts")
    count = distinct.count()
    owners, texts = distinct.select("node", F.col("own.who").alias("who")), rows.select("who", "text")
    alone = distinct.select("node", F.col("node").alias("label"), *_WORDS)
    chained = materialize(_chained(alone, count), "candidates")
    sets = _sets(chained.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, owners)
    first = _linked(chained, sets)
    for table in (sets, chained):
        discard(table)
    roots = components(first, name="close")
    labelled = materialize(distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"), *_WORDS), "labelled")
    sets = _sets(_with_candidates(labelled, count), texts, owners)
    second = _linked(_apart(_with_maps(labelled, sets), count), sets)
    discard(sets)
    roots = components(first.unionByName(second), name="near")
    rooted = materialize(distinct.join(roots, "node", "left").select("own", F.coalesce("root", "node").alias("root")), "rooted")
    kept = rooted.groupBy("root").agg(F.min("own").alias("best")).select(F.col("best.who").alias("who"))
    rows = docs.select(identity(key, text).alias("who"), identity(*docs.columns).alias("own"), F.struct("*").alias("row"))
    rows = rows.join(kept, "who", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("who").orderBy("own")))
    return rows.filter("place = 1").select("row.*")
