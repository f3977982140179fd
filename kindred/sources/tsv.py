"""Tab-separated sources and sinks: records, truth, pairs, results, ids, thresholds."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.constants import RECORD

DEFAULT_THRESHOLD = 0.78  # fixed value: used where no threshold has been chosen


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; an empty field is "", never null, and NA or null are plain words."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', encoding="UTF-8", nullValue="\u0000").csv(path).na.fill("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, RECORD)


def with_ids(records: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The records whose id is in ids (first column), each id once; Spark picks the join by size."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return records.join(wanted, key, "left_semi").dropDuplicates([key])


def head(records: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    """The first n records by id."""
    return records.orderBy(key).limit(n)


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    """Ids in the first column, trimmed, without the header and blank lines."""
    lines = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.trim(F.col(lines.columns[0])).alias("entity_id")).filter("entity_id <> ''").distinct()


def split_ids(ids: Column) -> Column:
    """A comma list as ids: trimmed, empties dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda i: F.trim(i)), lambda i: i != ""))


def truth_pairs(truth: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """source1_entity_id, target_entity_id of a table with comma lists; entities without matches drop out."""
    return truth.select("source1_entity_id", F.explode(split_ids(F.col(ids))).alias("target_entity_id"))


def read_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> float:
    """best_threshold of a JSON file, or of what write_threshold wrote, on any file system that Spark reads; the default if there is none."""
    try:
        return float(json.loads(spark.read.text(path, wholetext=True).first().value)["best_threshold"])
    except (AnalysisException, AttributeError, ValueError, KeyError, TypeError):
        return default


def write_threshold(spark: SparkSession, path: str, best: dict) -> None:
    """A folder with one JSON file."""
    text = json.dumps({"best_threshold": best["threshold"], **best}, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def best_in_table(results: DataFrame) -> float:
    """Threshold of the greatest macro_f05 in a table of results; of equal ones the lowest."""
    row = results.orderBy(F.desc("macro_f05"), F.asc("threshold")).first()
    return DEFAULT_THRESHOLD if row is None else float(row["threshold"])


def write_tsv(df: DataFrame, path: str) -> None:
    """A directory of part files with headers; fields are written as they are, empty ones as nothing."""
    df.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """A directory of part files that all begin with the header; the lines (column value) are written as they are."""
    # Spark gives every part its header. A separator that no line has leaves each line one field, which nothing quotes or trims.
    whole = {"sep": "\u0001", "quote": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.select(F.col("value").alias(header)).write.mode("overwrite").options(header=True, **whole).csv(path)
