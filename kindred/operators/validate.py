"""Checks of result files: rows (issue, n, examples), up to five examples each, all rules from one pass over the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.sources.scratch import written
from kindred.sources.tsv import split_ids

MATCHES, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """df, or ValueError that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{what}: no column {', '.join(lacking)}")
    return df


def parse_lines(lines: DataFrame, column: str) -> DataFrame:
    """source1_entity_id, ids, malformed of raw lines (column value) without the header."""
    parts = F.split("value", "\t", 2)
    return lines.filter(F.trim("value") != "").select(F.trim(parts[0]).alias("source1_entity_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias(column), (~F.contains("value", F.lit("\t"))).alias("malformed"))


def read_result(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A result file, or a folder of part files; ValueError if there is no line, or if a file does not begin with the header."""
    lines = spark.read.text(path)
    want = f"source1_entity_id\t{column}"
    # A file begins with the first row of its first block, and a task reads a block's rows in their order. Of several files
    # Spark reads the largest first, so the first row of all tells nothing of the others.
    starts = lines.filter("_metadata.file_block_start = 0").select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    heads = starts.groupBy("file_path").agg(F.min_by("value", "at").alias("head"))
    wrong = F.when(F.col("head") != want, F.struct("file_path", "head"))
    found = heads.agg(F.count(F.lit(1)).alias("files"), F.min(wrong).alias("wrong")).first()
    if not found.files:
        raise ValueError("the file is empty")
    if found.wrong is not None:
        raise ValueError(f"the header is {found.wrong.head!r}, not {want!r}: {found.wrong.file_path}")
    return parse_lines(lines.filter(F.col("value") != want), column)


def _report(found: DataFrame, names: list[str]) -> DataFrame:
    """issue, n, examples of rows (issue, example), for every name; each task keeps five examples an issue."""
    counts = written(found.groupBy("issue", "example").agg(F.count(F.lit(1)).alias("c")), "issues")
    totals = counts.groupBy("issue").agg(F.sum("c").alias("n"))
    order = Window.partitionBy("issue").orderBy("example")
    least = counts.withColumn("at", F.row_number().over(order)).filter("at <= 5").groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list("example")), ";").alias("examples"))
    every = found.sparkSession.createDataFrame([(n,) for n in names], "issue string")
    out = every.join(F.broadcast(totals.join(least, "issue")), "issue", "left")
    return out.select("issue", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def issues(result: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, column: str = MATCHES) -> DataFrame:
    """All issues of a result: result has source1_entity_id, the id list and, if parsed, malformed.

    required and known hold ids in their first column; candidates is a result with candidate_entity_ids. The result is
    read once: a row for each id of each list, the first of a list speaking for its row too, and a row for each required
    entity go to one table, from which all rules are told.
    """
    s1 = F.col("source1_entity_id")
    malformed = F.col("malformed") if "malformed" in result.columns else F.lit(False)
    raw = F.filter(F.transform(F.split(column, ","), lambda i: F.trim(i)), lambda i: i != "")
    rows = result.select(s1, malformed.alias("malformed"), raw.alias("ids"))
    rows = rows.withColumns({"twice": F.size("ids") != F.size(F.array_distinct("ids")), "none": F.size("ids") == 0})
    rows = rows.withColumn("ids", F.when(~F.col("malformed"), F.col("ids")))
    rows = rows.select(s1, "malformed", "twice", "none", F.posexplode_outer("ids").alias("at", "id")).withColumn("leads", F.coalesce(F.col("at") == 0, F.lit(True)))
    names = (["malformed row"] if "malformed" in result.columns else []) + ["duplicate entity", "duplicate id in list", "match within source 1", "wrong prefix", "missing entity", "extra entity", "empty list"]
    rows = rows.withColumns({"known": F.lit(True), "offered": F.lit(True)})
    if known is not None:
        names.append("unknown id")
        have = known.select(F.col(known.columns[0]).alias("id")).distinct().withColumn("have", F.lit(True))
        rows = rows.join(have, "id", "left").withColumn("known", F.coalesce("have", F.lit(False))).drop("have")
    if candidates is not None:
        names.append("match is no candidate")
        had = candidates.select(s1, F.explode(split_ids(F.col(CANDIDATES))).alias("id")).distinct().withColumn("had", F.lit(True))
        rows = rows.join(had, ["source1_entity_id", "id"], "left").withColumn("offered", F.coalesce("had", F.lit(False))).drop("had")
    need = required.select(F.col(required.columns[0]).alias("source1_entity_id")).distinct()
    # One row stands for a list and its ids, so a list's own rules are told by its first.
    rows = rows.withColumn("required", F.lit(False)).unionByName(need.withColumn("required", F.lit(True)), allowMissingColumns=True)
    rows = written(rows, "checked")
    good, pair, link = F.col("leads") & ~F.col("malformed"), F.col("id").isNotNull(), F.concat_ws(">", s1, "id")
    told = {
        "malformed row": (F.col("leads") & F.col("malformed"), s1),
        "duplicate id in list": (good & F.col("twice"), s1),
        "empty list": (good & F.col("none"), s1),
        "match within source 1": (pair & F.col("id").startswith("S1-"), link),
        "wrong prefix": (pair & ~F.col("id").rlike("^S[123]-"), link),
        "unknown id": (pair & ~F.col("known"), link),
        "match is no candidate": (pair & ~F.col("offered"), link),
    }
    own = F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), e.cast("string").alias("example"))) for n, (c, e) in told.items() if n in names])
    found = rows.filter(~F.col("required")).select(F.explode(F.filter(own, lambda i: i.isNotNull())).alias("i")).select("i.issue", "i.example")
    entities = rows.groupBy(s1).agg(F.count_if(good).alias("lists"), F.bool_or("required").alias("need"))
    lists = F.col("lists")
    whole = F.array(
        F.when(lists > 1, F.lit("duplicate entity")), F.when(F.col("need") & (lists == 0), F.lit("missing entity")), F.when(~F.col("need") & (lists > 0), F.lit("extra entity"))
    )
    found = found.unionByName(entities.select(F.explode(F.filter(whole, lambda i: i.isNotNull())).alias("issue"), s1.cast("string").alias("example")))
    return _report(found, names)
