"""Scoring with gradient-boosted trees, and ranking metrics."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.constants import FEATURES
from kindred.operators.validate import require
from kindred.sources.scratch import written

#: Rows are fitted as distinct rows with weights; a weight is at most this share of all, one row at least.
PIECES = 100_000


def numeric(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Feature columns as numbers; what is none becomes 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


@dataclass
class TreeConfig:
    """How trees are grown: up to `trees`, fewer where held-out rows stop gaining by `tolerance`.

    Leaves have at least `min_rows` rows; a tree sees shares of the rows and, at each node, of the features. There is
    no L1 or L2 term in these trees; min_rows, depth and rate hold them back. Of more than PIECES rows equal ones are
    drawn together, PIECES-ths of all rows at most.
    """

    trees: int = 2000
    depth: int = 6
    rate: float = 0.05
    min_rows: int = 100
    row_share: float = 0.8
    feature_share: float = 0.8
    tolerance: float = 0.001
    seed: int = 42


def train(df: DataFrame, config: TreeConfig | None = None, **changes) -> PipelineModel:
    """Fit on label; where is_validation is given, those rows stop the growth and are not fitted. changes: fields of TreeConfig."""
    config = TreeConfig(**(asdict(config or TreeConfig()) | changes))
    require(df, [*FEATURES, "label"], "training rows")
    rows, total = weighted(numeric(df).withColumn("label", F.col("label").cast("double")))
    # Leaves are held back by the weight of their rows, which is their number; half a row less, as a share of all is no whole number.
    # MLlib takes shares below a half. From a half on no split has two such sides.
    share = (config.min_rows - 0.5) / max(1, total)
    limits = {"minWeightFractionPerNode": max(0.0, share)} if share < 0.5 else {"minInstancesPerNode": (1 << 31) - 1}
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features")]
    options = {"validationIndicatorCol": "is_validation", "validationTol": config.tolerance} if "is_validation" in df.columns else {}
    stages.append(GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="times", maxIter=config.trees, maxDepth=config.depth, stepSize=config.rate, subsamplingRate=config.row_share,
        featureSubsetStrategy=str(config.feature_share), seed=config.seed, **limits, **options,
    ))
    return Pipeline(stages=stages).fit(rows)


def weighted(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (FEATURES, label, is_validation) with times, their number, and how many rows are fitted in all.

    A distinct row with more than a PIECES-th of all rows is cut into several, so that no draw of rows hangs on a few.
    """
    keys = [*FEATURES, "label", *(["is_validation"] if "is_validation" in rows.columns else [])]
    grouped = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "distinct-rows")
    own = grouped.filter("not is_validation") if "is_validation" in keys else grouped
    total = own.agg(F.sum("n")).first()[0] or 0
    pieces = F.ceil(F.col("n") / F.lit(max(1.0, total / PIECES))).cast("long")
    cut = grouped.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces"))))
    times = F.expr("n div pieces") + (F.col("piece") <= F.col("n") % F.col("pieces")).cast("long")
    return cut.select(*keys, times.cast("double").alias("times")), total


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction_probability."""
    require(df, FEATURES, "rows to score")
    keep = [c for c in df.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
    return model.transform(numeric(df)).select(*keep, vector_to_array("probability")[1].alias("prediction_probability"))


def save(model: PipelineModel, path: str, metrics: dict | None = None, config: TreeConfig | None = None) -> None:
    """The model at path, and features, parameters, importances and metrics as JSON text at path-metadata."""
    model.write().overwrite().save(path)
    trees = model.stages[-1]
    about = {"features": FEATURES, "trees": trees.getNumTrees, "parameters": asdict(config) if config else {}, "importances": dict(importances(model)), "metrics": metrics or {}}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}-metadata")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_metadata(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(f"{path.rstrip('/')}-metadata").first().value)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, map(float, values), strict=True), key=lambda p: (-p[1], p[0]))


def _by_score(df: DataFrame, label: str, score_col: str) -> DataFrame:
    """Positives and negatives at each distinct score; as many rows as scores, whatever the ties."""
    return df.groupBy(F.col(score_col).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def _running(grouped: DataFrame) -> DataFrame:
    """grouped with the positives (tp) and negatives (fp) of greater scores, in two steps of ranges.

    Distinct scores are cut into a thousand ranges of (0, 1); the ranges' sums are ordered in one task, rows within a range.
    """
    cell = F.floor(F.col("s") * 1000)
    cut = grouped.withColumn("_cell", cell)
    sums = cut.groupBy("_cell").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_cell", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c + "0") for c in ("_p", "_n")])
    within = Window.partitionBy("_cell").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumns({"_pi": F.coalesce(F.sum("p").over(within), F.lit(0)), "_ni": F.coalesce(F.sum("n").over(within), F.lit(0))})
    return run.join(sums, "_cell").select("s", "p", "n", (F.col("_p0") + F.col("_pi")).alias("tp"), (F.col("_n0") + F.col("_ni")).alias("fp"))


def roc_auc(df: DataFrame, label: str = "label", score_col: str = "prediction_probability") -> DataFrame:
    """One row, auc: the chance that a positive scores above a negative, ties counting half; null without either."""
    area = F.sum(F.col("n") * (F.col("tp") + F.col("p") / 2.0))
    return _running(_by_score(df, label, score_col)).agg(F.try_divide(area, F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", score_col: str = "prediction_probability") -> DataFrame:
    """One row, average_precision: precision at each distinct score, weighted by the recall it adds."""
    precision = (F.col("tp") + F.col("p")) / (F.col("tp") + F.col("p") + F.col("fp") + F.col("n"))
    return _running(_by_score(df, label, score_col)).agg((F.sum(precision * F.col("p")) / F.sum("p")).alias("average_precision"))
