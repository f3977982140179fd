"""Chat formatting: conversations that are snapshots of longer ones collapse, the rest are rendered.

Turns of a conversation are ordered by turn. A rolling hash of the turns so far (two sums modulo 2^61 - 1
of hashes of each turn's role, text and rank) stands for each prefix, so a conversation is a snapshot if the hash
of all its turns is the hash of a proper prefix of another. Full hashes are matched with the distinct
prefix hashes by a left anti-join; of equal conversations the least conv_id stays.

Nothing gathers a conversation in one place: ranks and prefix sums are made in spans of `SPAN` turn
numbers and spans are summed up in a second step, which a conversation of any length divides into.
A rendered conversation comes in parts of one span each, almost always one.

Nulls: a null role or text is told apart from an empty one and rendered as nothing; rows with a null
conv_id or turn belong to no conversation and are left out. Repeated turns of one number are ordered by
role and text. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import materialize

SPAN = 4096
PRIME = 2305843009213693951  # 2**61 - 1
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hashes(role: Column, text: Column, rank: Column) -> list[Column]:
    """What a turn adds to the two hashes of its prefix: a hash of the turn and of its rank, below 2**31."""
    return [F.pmod(F.xxhash64(F.lit(seed), role.isNull(), role, text.isNull(), text, rank), F.lit(PRIME)).cast("decimal(38,0)") for seed in (1, 2)]


def _key(total: list[Column]) -> list[Column]:
    return [(t % F.lit(PRIME)).cast("long") for t in total]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, span, rank (from 1), role, text and the two hashes of all turns up to this one."""
    rows = turns.filter("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    sizes = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks"))
    within = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    ranked = rows.withColumn("at", F.row_number().over(within))
    ranked = ranked.join(offsets, (F.col("conv_id") == F.col("c")) & (F.col("span") == F.col("s"))).withColumn("rank", F.col("ranks") + F.col("at"))
    a, b = _turn_hashes(F.col("role"), F.col("text"), F.col("rank"))
    ranked = materialize(ranked.select("conv_id", "span", "rank", "role", "text", a.alias("a"), b.alias("b")), "turns")
    sums = ranked.groupBy("conv_id", "span").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), *[F.coalesce(F.sum(x).over(before.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(y) for x, y in (("sa", "fa"), ("sb", "fb"))])
    running = Window.partitionBy("conv_id", "span").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumns({"ra": F.sum("a").over(running), "rb": F.sum("b").over(running)})
    out = out.join(sums, (F.col("conv_id") == F.col("c")) & (F.col("span") == F.col("s")))
    ha, hb = _key([F.col("fa") + F.col("ra"), F.col("fb") + F.col("rb")])
    return out.select("conv_id", "span", "rank", "role", "text", ha.alias("ha"), hb.alias("hb"))


def maximal(marked: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another; of equal ones the first."""
    ends = marked.groupBy("conv_id").agg(F.max(F.struct("rank", "ha", "hb")).alias("e")).select("conv_id", F.col("e.rank").alias("n_turns"), F.col("e.ha").alias("ha"), F.col("e.hb").alias("hb"))
    one = ends.groupBy("n_turns", "ha", "hb").agg(F.min("conv_id").alias("conv_id"))
    last = ends.select(F.col("conv_id").alias("c"), F.col("n_turns").alias("last"))
    inner = marked.select("conv_id", "rank", "ha", "hb").join(last, F.col("conv_id") == F.col("c")).filter("rank < last")
    inner = inner.select(F.col("rank").alias("r"), F.col("ha").alias("pa"), F.col("hb").alias("pb")).distinct()
    return one.join(inner, (F.col("n_turns") == F.col("r")) & (F.col("ha") == F.col("pa")) & (F.col("hb") == F.col("pb")), "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), text (turns of the part in the chat template)."""
    marked = materialize(prefixes(turns), "prefixes")
    kept = maximal(marked).withColumnRenamed("conv_id", "c")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE), F.lit("\n"))
    rows = marked.join(kept, F.col("conv_id") == F.col("c")).select("conv_id", "span", "rank", "n_turns", line.alias("line"))
    parts = rows.groupBy("conv_id", "span", "n_turns").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"), F.min("rank").alias("first"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1
    return parts.select("conv_id", number.cast("int").alias("part"), "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank, coalesce(role, '') AS role, coalesce(text, '') AS text,
         coalesce('r' || length(role) || role, 'n') || coalesce('t' || length(text) || text, 'n') AS whole
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), prefixes AS (
  SELECT conv_id, rank, md5(string_agg(whole, '') OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n FROM turns
), ends AS (
  SELECT min(conv_id) AS conv_id, n, h FROM prefixes WHERE rank = n GROUP BY n, h
), kept AS (
  SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.h = e.h AND p.rank = e.n AND p.rank < p.n)
)
SELECT k.conv_id, 0 AS part, k.n AS n_turns,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.rank) AS text
FROM kept k JOIN turns t ON t.conv_id = k.conv_id GROUP BY k.conv_id, k.n
"""
