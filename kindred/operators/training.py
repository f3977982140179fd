"""Training sets: sampling, labels, hard negatives and the grouped split.

All draws are ordered or bucketed by MD5 of the id and a seed: uniform, the same on every run and every
cluster, and expressible in any engine. A split is by entity, so no entity is on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators.blocking import candidate_pairs, key_index
from kindred.operators.features import pair_features
from kindred.operators.validate import require

SEED = 42  # fixed value
NEGATIVES = 20  # fixed value: negatives kept for an entity
PAIR = ["source1_entity_id", "target_entity_id"]


def draw(*parts: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def sample_ids(records: DataFrame, n: int, key: str = "entity_id", seed: int = SEED) -> DataFrame:
    """n distinct ids, drawn uniformly; a top-k, so no total sort."""
    return records.select(key).distinct().orderBy(draw(F.col(key), seed=seed), key).limit(n)


def required_targets(truth_pairs: DataFrame, prefix: str) -> DataFrame:
    return truth_pairs.filter(F.col("target_entity_id").startswith(prefix)).select(F.col("target_entity_id").alias("entity_id")).distinct()


def sample_targets(targets: DataFrame, required: DataFrame, n: int = 0, seed: int = SEED, share: float | None = None) -> DataFrame:
    """The required records and, up to n in all, others drawn uniformly from the whole table.

    With share, as many others as that share of the required ones. Others are counted off in 4,096 ranges of their
    draw, whose sizes are ordered in one task, and by rank in the one range where the sample ends.
    """
    marked = targets.dropDuplicates(["entity_id"]).join(required.withColumn("_needed", F.lit(True)), "entity_id", "left")
    marked = marked.withColumn("_draw", draw(F.col("entity_id"), seed=seed)).withColumn("_range", F.substring("_draw", 1, 3))
    needed = marked.filter("_needed")
    others = marked.filter("_needed is null")
    have = F.count(F.lit(1))
    room = needed.agg((F.floor(have * F.lit(share)) if share is not None else F.greatest(F.lit(0), F.lit(n) - have)).cast("long").alias("_room"))
    sizes = others.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before")).join(F.broadcast(room), F.lit(True)).filter("_before < _room")
    ranked = others.join(F.broadcast(sizes), "_range")
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy("_draw", "entity_id")) + F.col("_before"))
    return needed.select(*targets.columns).unionByName(ranked.filter("_at <= _room").select(*targets.columns))


def positives(truth_pairs: DataFrame, source1: DataFrame, target: DataFrame) -> DataFrame:
    """True pairs whose records are both there."""
    s1 = source1.select(F.col("entity_id").alias(PAIR[0]))
    t = target.select(F.col("entity_id").alias(PAIR[1]))
    return truth_pairs.select(*PAIR).join(s1, PAIR[0], "left_semi").join(t, PAIR[1], "left_semi").select(*PAIR).distinct()


def labelled(candidates: DataFrame, positive: DataFrame) -> DataFrame:
    """Candidates and positives as PAIR and label; positives that blocking missed are put in."""
    return marked_pairs(candidates, positive).drop("offered")


def marked_pairs(candidates: DataFrame, positive: DataFrame) -> DataFrame:
    """labelled with offered: whether blocking found the pair."""
    found = candidates.select(F.col(PAIR[0]), F.col("candidate_entity_id" if "candidate_entity_id" in candidates.columns else PAIR[1]).alias(PAIR[1]), F.lit(0).alias("label"), F.lit(True).alias("offered"))
    both = found.unionByName(positive.select(*PAIR, F.lit(1).alias("label"), F.lit(False).alias("offered")))
    return both.groupBy(*PAIR).agg(F.max("label").cast("tinyint").alias("label"), F.bool_or("offered").alias("offered"))


def cap_negatives(pairs: DataFrame, most: int = NEGATIVES, seed: int = SEED) -> DataFrame:
    """All positives and, for each entity, up to `most` negatives drawn uniformly."""
    return marked_negatives(pairs, most, seed).filter("kept").drop("kept")


def marked_negatives(pairs: DataFrame, most: int = NEGATIVES, seed: int = SEED) -> DataFrame:
    """pairs with kept: whether cap_negatives keeps the pair."""
    order = Window.partitionBy(PAIR[0], "label").orderBy(draw(F.col(PAIR[0]), F.col(PAIR[1]), seed=seed), PAIR[1])
    return pairs.withColumn("_at", F.row_number().over(order)).withColumn("kept", (F.col("label") == 1) | (F.col("_at") <= most)).drop("_at")


def training_pairs(source1: DataFrame, targets: dict[str, DataFrame], truth_pairs: DataFrame, most: int = NEGATIVES, seed: int = SEED, candidates: dict[str, DataFrame] | None = None) -> DataFrame:
    """PAIR, label, source of every target table; candidates: those of each target, where they are there already."""
    out, index = None, None if candidates else key_index(source1)
    for name, target in targets.items():
        found = candidates[name] if candidates else candidate_pairs(index, target)
        pairs = labelled(found, positives(truth_pairs, source1, target))
        own = cap_negatives(pairs, most, seed).withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def training_features(pairs: DataFrame, source1: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """The features of training pairs, with label and source."""
    require(pairs, [*PAIR, "label", "source"], "training pairs")
    out = None
    for name, target in targets.items():
        own = pair_features(pairs.filter(F.col("source") == name), source1, target)
        out = own if out is None else out.unionByName(own)
    return out


def composition(pairs: DataFrame) -> DataFrame:
    """source, label, n_pairs, n_entities of training pairs."""
    return pairs.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(PAIR[0]).alias("n_entities"))


def check_split(rows: DataFrame, group: str = PAIR[0]) -> DataFrame:
    """rows, or ValueError if an entity is on both sides of is_validation."""
    both = rows.groupBy(group).agg(F.bool_or("is_validation").alias("a"), F.bool_and("is_validation").alias("b")).filter("a and not b")
    found = [r[0] for r in both.select(group).orderBy(group).limit(5).collect()]
    if found:
        raise ValueError(f"entities on both sides of the split: {', '.join(map(str, found))}")
    return rows


def grouped_split(pairs: DataFrame, percent: int = 20, seed: int = SEED, group: str = PAIR[0]) -> DataFrame:
    """pairs with is_validation, the same for all rows of an entity."""
    bucket = F.conv(F.substring(draw(F.col(group), seed=seed), 1, 8), 16, 10).cast("long") % 100
    return pairs.withColumn("is_validation", bucket < percent)
