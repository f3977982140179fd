"""SimHash near-duplicates, found with a Gray-order hierarchical index.

1. Fingerprints. A text's ASCII letters are lower-cased, its words are the runs of other code points
   than space and tab..carriage return, and its shingles are `width` words joined by spaces, repeats
   included (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is set in over
   half of the shingles' XXH64 values. Texts are hashed one row at a time in Arrow batches, some shingles
   at a time; a text's words are held at once.
2. Distinct fingerprints. Copies collapse to one row, which knows its smallest key, before anything
   is linked, so a group of equal texts costs one row however large it is.
3. Candidate groups. 64 bits are cut into m blocks; two fingerprints within `radius` bits agree on
   at least m - radius blocks, so every choice of m - radius blocks is one table, and each fingerprint
   is in one group of every table. More blocks mean more tables and smaller groups; m follows the count.
4. The index, built in the task that holds a group. Fingerprints are sorted by Gray rank, in which
   neighbours differ in few bits. Runs of neighbours become leaves, runs of nodes become upper nodes;
   a node keeps the bit pattern (value and mask) that all below it share. Two nodes are compared on the
   bits both have fixed, and a child pair adds only the bits its parents had not fixed to the
   differences counted so far. Beyond `radius` the whole pair of groups is pruned; if the bits that are
   still free cannot bring it beyond `radius`, all below are linked at once; and a pair whose members are
   linked already is skipped, so a dense group costs a chain of links and not its pairs. A task holds about
   ROWS_AT_ONCE rows, or one group. Distinct fingerprints share a block value by chance only, or within a
   dense group, and m grows with their number: a group has some hundred of them on average, 24 bytes each.
5. Components of the links, by star rounds over the shared folder; the class is named by its smallest key.

Nulls: a null text has fingerprint zero. Rows with a null key are linked like others; a component is
named by its smallest key that is not null (null if none). Repeated keys are allowed: classes are of
fingerprints, so rows of one key with different texts stay apart. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import identity, join_groups, materialize
from kindred.llm.components import components

SEED = 42
LEAF = FAN = 16
PAIRS_AT_ONCE = 1 << 19
SLICE = 1 << 16
ROWS_AT_ONCE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of one text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    size, ones, total = min(width, len(words)), np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    for at in range(0, len(words) - size + 1, SLICE):  # a slice of shingles at a time
        part = words[at : at + SLICE + size - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends.tolist()[size - 1 :])])  # noqa: B905  starts is longer
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 4) -> DataFrame:
    """The columns keep and fp (a signed long with the fingerprint's bits) of every row."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in batch.columns[-1]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long"]))


def choose_blocks(count: int, radius: int) -> int:
    """Blocks m that cost least for count fingerprints: tables, each with its share of pairs to test."""
    def cost(m: int) -> float:
        tables = len(list(itertools.combinations(range(m), m - radius)))
        group = count / 2 ** (64 * (m - radius) // m)
        return tables * count * (200 + group)  # a row shuffled costs about as much as 200 pair tests

    return min(range(radius + 1, radius + 6), key=cost)


def block_masks(m: int, radius: int) -> list[int]:
    """For each table the bits of its m - radius blocks, as signed longs."""
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in itertools.combinations(blocks, m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray order of 64-bit numbers."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Groups:
    """Links so far: each item's label, least item of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _levels(starts: np.ndarray, ends: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each range into runs of fan: starts, ends and the number of runs of each range."""
    count = -(-(ends - starts) // fan)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = np.repeat(starts, count) + inside * fan
    return a, np.minimum(a + fan, np.repeat(ends, count)), count


def link_groups(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items, and for each its label: the first item of its component within its group."""
    order = np.lexsort((gray_rank(fps), group))
    group, fps = group[order], fps[order]
    n = len(fps)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sets = _Groups(n)
    if not n:
        return order, sets.label
    # levels[0] are leaves over items; levels[k] are nodes over levels[k - 1]; the last has a node a group.
    levels, starts, ends = [], edges, np.append(edges[1:], n)
    ones, ands = fps, fps
    while True:
        a, z, count = _levels(starts, ends, LEAF if not levels else FAN)
        ones, ands = np.bitwise_or.reduceat(ones, a), np.bitwise_and.reduceat(ands, a)
        first = levels[-1]["first"][a] if levels else a
        last = levels[-1]["last"][z - 1] if levels else z
        levels.append({"a": a, "z": z, "mask": ~(ones ^ ands), "bits": ands, "first": first, "last": last})
        if (count == 1).all():
            break
        ends = np.cumsum(count)
        starts = ends - count
    limit = np.uint8(radius)
    roots = np.arange(len(levels[-1]["a"]))
    roots = roots[levels[-1]["last"] - levels[-1]["first"] > 1]
    zero = np.zeros(len(roots), np.uint64)
    stack = [(len(levels) - 1, roots, roots, zero, np.zeros(len(roots), np.uint8))]
    while stack:
        depth, p, q, fixed, acc = stack.pop()
        level = levels[depth]
        if len(p) > (cut := PAIRS_AT_ONCE // (FAN * FAN)):
            stack += [(depth, p[i : i + cut], q[i : i + cut], fixed[i : i + cut], acc[i : i + cut]) for i in range(0, len(p), cut)]
            continue
        # Differences so far, and those in bits that both nodes fix and their parents did not.
        both = level["mask"][p] & level["mask"][q]
        acc = acc + np.bitwise_count((level["bits"][p] ^ level["bits"][q]) & both & ~fixed)
        near = acc <= limit
        p, q, both, acc = p[near], q[near], both[near], acc[near]
        first_p, first_q, last_p, last_q = level["first"][p], level["first"][q], level["last"][p], level["last"][q]
        sure = acc + np.bitwise_count(~both) <= limit
        if sure.any():
            for f, e in ((first_p, last_p), (first_q, last_q)):
                size = (e - f)[sure]
                at = np.repeat(f[sure], size)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                sets.link(np.repeat(first_p[sure], size), at + inside)
        low = np.minimum.reduceat(sets.label, level["first"])
        high = np.maximum.reduceat(sets.label, level["first"])
        one = (low[p] == high[p]) & (low[q] == high[q]) & (low[p] == low[q])
        go = ~(sure | one)
        p, q, both, acc = p[go], q[go], both[go], acc[go]
        if not len(p):
            continue
        np_, nq = level["z"][p] - level["a"][p], level["z"][q] - level["a"][q]
        total = np_ * nq
        inside = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nq, total)
        left = np.repeat(level["a"][p], total) + inside // width
        right = np.repeat(level["a"][q], total) + inside % width
        ahead = (left < right) if depth == 0 else (left <= right)
        left, right = left[ahead], right[ahead]
        if depth == 0:
            close = np.bitwise_count(fps[left] ^ fps[right]) <= limit
            sets.link(left[close], right[close])
        else:
            both, acc = np.repeat(both, total)[ahead], np.repeat(acc, total)[ahead]
            same = left == right  # a node with itself links its neighbours first; that prunes much of the rest
            stack.append((depth - 1, left[~same], right[~same], both[~same], acc[~same]))
            stack.append((depth - 1, left[same], right[same], both[same], acc[same]))
    return order, sets.label


def links(distinct: DataFrame, radius: int, count: int) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp) within radius, not all their pairs."""
    masks = block_masks(choose_blocks(count, radius), radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)]))
    rows = distinct.select("fp", tables.alias("g")).select("g.t", "g.bits", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        t, bits, fp = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3))
        group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (bits[1:] != bits[:-1])]))
        order, label = link_groups(group, fp.view(np.uint64), radius)
        fp = fp[order]
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by group. Whole groups are linked once enough rows are held; only a group is held as a whole.
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size > ROWS_AT_ONCE:
                t, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                edges = np.flatnonzero((t[1:] != t[:-1]) | (bits[1:] != bits[:-1])) + 1
                if len(edges):
                    cut = int(edges[-1])
                    yield linked([*held[:-1], batch.slice(0, cut)])
                    held, size = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield linked(held)

    return rows.repartition("t", "bits").sortWithinPartitions("t", "bits").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def classes(prints: DataFrame, radius: int, best) -> DataFrame:
    """fp, copies, best: for every fingerprint of prints its rows and the best value of its component.

    best is a column of prints, and the least of it stands for a component.
    """
    distinct = materialize(prints.groupBy("fp").agg(F.min(best).alias("own"), F.count(F.lit(1)).alias("copies")), "distinct")
    count = distinct.count()
    roots = components(links(distinct, radius, count), name="simhash")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "copies", "own", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("size")), "classes")
    return join_groups(rooted, least, "root", "size", count).select(F.col("fp").alias("_fp"), "copies", "best")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id and copies (rows with the same fingerprint)."""
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    prints = materialize(fingerprints(rows, [key], text, width), "fingerprints")
    found = classes(prints, radius, F.col(key))
    found = materialize(found, "found")
    return join_groups(prints, found.withColumnRenamed("_fp", "fp"), "fp", "copies", prints.count()).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"), "copies"
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs, all columns, of each component: that with the least key (null keys last).

    Of rows equal in key and text that with the least identity of all columns stays. Columns may have any names.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), identity(key, text).alias("who"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, ["key", "who"], "text", width), "fingerprints")
    best = F.struct(F.col("key").isNull().alias("none"), "key", "who")
    kept = classes(prints, radius, best).select(F.col("best.who").alias("who")).distinct()
    rows = docs.select(identity(key, text).alias("who"), identity(*docs.columns).alias("own"), F.struct("*").alias("row"))
    rows = rows.join(kept, "who", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("who").orderBy("own")))
    return rows.filter("place = 1").select("row.*")
