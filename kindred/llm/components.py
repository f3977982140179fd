"""Connected components of a link table: alternating large-star and small-star rounds.

Nodes are values of one type that can be ordered, such as longs. Each round replaces a node's links by links
to the least node it sees, through partial aggregates and equi-joins only; the links of a hub are not shuffled
for the join with its aggregate row (join_groups). Every round is a table in the shared folder, so a lost
executor costs a re-read, not the history; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, join_groups, materialize


def _larger(both: DataFrame, rows: DataFrame, own: Column) -> DataFrame:
    """rows (a, b) with the least node m that a sees."""
    total = both.count()
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", own.alias("m"), "n"), "least")
    return join_groups(rows, least, "a", "n", total)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _larger(both, both.filter("b > a"), F.least("a", "m"))
    return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = _larger(down, down, F.col("m"))
    moved = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(met.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """node, root: the least node reachable, for every node that is not its own root.

    Links may repeat, run either way or join a node to itself; rows with a null end are no links.
    """
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), name)
    mark = None
    while True:
        large = materialize(_large_star(now), name)
        after = materialize(_small_star(large), name)
        discard(now)
        discard(large)
        now = after
        # Stars are the fixed point: the same rows after a round means every root is reached.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
