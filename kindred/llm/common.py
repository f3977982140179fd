"""Pieces the corpus operators share: shared storage, word arrays, null-safe text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing and Spark runs inside one machine is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[key], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python so many rows at once at most; a batch of long texts is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to be computed reads it."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column | str) -> Column:
    """Words of a text in order; none for a null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def identity(*columns: str) -> Column:
    """32 bytes that tell rows apart by columns; a null is a value of its own, as JSON writes it."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups, a table with one row a key and how many rows have it (size; total in all).

    Keys with over a ten-thousandth of all rows (1,000 at least) are no more than 10,000 keys, as their sizes add up
    to total at most; that part of groups is broadcast, so that a hot key's rows stay where they are.
    """
    limit = max(1000, total // 10_000)
    hot = groups.filter(F.col(size) > limit)
    if not hot.limit(1).count():
        return rows.join(groups, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= limit), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def numbered(df: DataFrame, first: Column, count: str, out: str, step: int = 4096) -> DataFrame:
    """df with a row for each of count numbers from first on, made in ranges so that no array holds them all."""
    span = fresh_name(df, "_span")
    start = fresh_name(df, "_start")
    ranges = df.withColumn(start, first).withColumn(span, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / step))))
    low = F.col(start) + F.col(span) * step
    return ranges.withColumn(out, F.explode(F.sequence(low, F.least(low + step - 1, F.col(start) + F.col(count) - 1)))).drop(span, start)
