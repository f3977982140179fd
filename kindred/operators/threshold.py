"""Entity-level macro F0.5 and the search for a threshold.

The 86 thresholds are neither 86 passes nor 86 rows an entity. An entity's scores change only at thresholds where
one of its pairs falls: it gives the differences there, as many rows as it has pairs at most, and prefix sums over
the 86 sums of differences give the macro averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEASURES = ("precision", "recall", "f05")
GRID = [t / 100 for t in range(10, 96)]  # fixed values: 0.10 to 0.95


def entity_scores(n_true: Column, n_predicted: Column, n_hit: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F0.5 of an entity; without any true or predicted match all are 1."""
    one, zero = F.lit(1.0), F.lit(0.0)
    none = (n_true == 0) & (n_predicted == 0)
    precision = F.when(none, one).when(n_predicted == 0, zero).otherwise(n_hit / n_predicted)
    recall = F.when(none, one).when(n_true == 0, zero).otherwise(n_hit / n_true)
    f05 = F.when(none, one).when(n_hit == 0, zero).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    return precision, recall, f05


def entity_f05(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """source1_entity_id, precision, recall, f05 of every entity of entities (first column)."""
    ids = entities.select(F.col(entities.columns[0]).alias("source1_entity_id")).distinct()
    pair = ["source1_entity_id", "target_entity_id"]
    both = predicted.select(*pair, F.lit(1).alias("said"), F.lit(0).alias("is")).distinct().unionByName(truth.select(*pair, F.lit(0).alias("said"), F.lit(1).alias("is")).distinct())
    pairs = both.groupBy(*pair).agg(F.max("said").alias("said"), F.max("is").alias("is"))
    counts = pairs.groupBy("source1_entity_id").agg(F.sum("is").alias("n_true"), F.sum("said").alias("n_predicted"), F.sum(F.col("is") * F.col("said")).alias("n_hit"))
    joined = ids.join(counts, "source1_entity_id", "left").na.fill(0, ["n_true", "n_predicted", "n_hit"])
    p, r, f = entity_scores(F.col("n_true"), F.col("n_predicted"), F.col("n_hit"))
    return joined.select("source1_entity_id", p.alias("precision"), r.alias("recall"), f.alias("f05"))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f05").alias("macro_f05"))


def sweep(predictions: DataFrame, truth: DataFrame, scope: str = "predicted", entities: DataFrame | None = None) -> DataFrame:
    """threshold, macro_precision, macro_recall, macro_f05 for each threshold of GRID.

    predictions: source1_entity_id, target_entity_id, prediction_probability. scope "predicted" averages over the
    entities that have predictions; "all" over entities, where those without any count too.
    """
    pair = ["source1_entity_id", "target_entity_id"]
    # The last threshold a pair passes: 10 .. 95, or 9 if it passes none.
    steps = F.size(F.filter(F.array(*[F.lit(t) for t in GRID]), lambda t: F.col("prediction_probability") >= t))
    # One shuffle by entity serves the pairs, the cells and the running sums.
    own = predictions.select(*pair, "prediction_probability").repartition(pair[0])
    own = own.groupBy(*pair).agg(F.max("prediction_probability").alias("prediction_probability"))
    right = truth.select(*pair).distinct()
    cells = own.join(right.withColumn("hit", F.lit(1)), pair, "left").select(pair[0], steps.cast("int").alias("above"), F.coalesce("hit", F.lit(0)).alias("hit"))
    cells = cells.groupBy(pair[0], "above").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    if scope == "all":
        cells = entities.select(F.col(entities.columns[0]).alias(pair[0])).distinct().join(cells, pair[0], "left").na.fill(0, ["above", "n", "h"])
    cells = cells.join(right.groupBy(pair[0]).agg(F.count(F.lit(1)).alias("n_true")), pair[0], "left").na.fill(0, ["n_true"])
    # A pair that passes `above` thresholds counts at the first `above` of them, so an entity's scores change there alone,
    # seen from the highest threshold down: what changes is all that leaves the entity.
    down = Window.partitionBy(pair[0]).orderBy(F.desc("above"))
    sums = down.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"n_predicted": F.sum("n").over(sums), "n_hit": F.sum("h").over(sums), "first": F.row_number().over(down) == 1})
    scored = cells.withColumns(dict(zip(MEASURES, entity_scores(F.col("n_true"), F.col("n_predicted"), F.col("n_hit")), strict=True)))
    alone = dict(zip(MEASURES, entity_scores(F.col("n_true"), F.lit(0), F.lit(0)), strict=True))
    change = {m: F.col(m) - F.coalesce(F.lag(m).over(down), alone[m]) for m in MEASURES}
    start = {f"{m}_start": F.when(F.col("first"), alone[m]).otherwise(0.0) for m in MEASURES}
    moves = scored.select("above", "first", *[v.alias(k) for k, v in (change | start).items()])
    moves = moves.groupBy("above").agg(F.count_if("first").alias("entities"), *[F.sum(c).alias(c) for c in (*change, *start)])
    # 87 rows at most from here on.
    totals = moves.agg(F.sum("entities").alias("entities_all"), *[F.sum(c).alias(f"{c}_all") for c in start])
    grid = predictions.sparkSession.range(len(GRID)).select(F.col("id").cast("int").alias("step"))
    at = grid.join(F.broadcast(moves), F.col("above") > F.col("step"), "left").groupBy("step").agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES])
    out = at.join(F.broadcast(totals), F.lit(True)).filter("entities_all > 0")
    return out.select(((F.col("step") + 10) / F.lit(100.0)).alias("threshold"), *[((F.col(f"{m}_start_all") + F.col(m)) / F.col("entities_all")).alias(f"macro_{m}") for m in MEASURES])


def best(results: DataFrame) -> DataFrame:
    """The row of the greatest macro_f05; of equal ones the highest threshold."""
    return results.orderBy(F.desc(F.round("macro_f05", 12)), F.desc("threshold")).limit(1)
