"""Window panes with revisions: transformWithStateInPandas per (kind, event hour).

Clicks come in numbered batches, each fed to one Structured Streaming query that is started anew on the same
checkpoint. A pane (kind, hour) keeps one value: its totals, and whether they are published. Two event-time timers
drive it, one after the other. The grace timer, `grace` hours after the hour's end, publishes a pane (`emit`). A published
pane that gets rows is revised at once (`retract` with the old totals, `replace` with the new). The close timer, `close`
hours after the end, forgets the pane; rows of a closed pane go straight to the output (`late`). A sentinel row in every batch lets
an empty batch run; the last batch's sentinel lies beyond every event, so that one closing run lets all timers fire and
panes that were never published come out as `final`.

Scale: a batch's rows are summed per pane within each map task before the shuffle, so a pane with a third of all rows
reaches its state as one row a task. Late rows have no state to meet and are dealt over `spread` keys of their own. The driver sees
one number a batch, the greatest event time, which tells map tasks what to leave unsummed; the state decides by Spark's
own watermark and stops the query if the two disagree. State lives in the state store (RocksDB), files and output below
spark.checkpoint.dir in a new folder a call. A repeated micro-batch overwrites its own output folder. What a start costs
for each state partition counts most where partitions are many: every call to the state, timers included, is a message
between Python and Spark, and output is written by as many tasks as there are cores, not by one for each state partition.

Event times are shifted by a million days, as Spark's watermark starts at 1970 and never falls below.

Nulls: a null ts is left out; a null kind is `none`; a null value, NaN and infinite ones count no cents; a null
arrived_at is taken to be ts; a null click_id is an id like others and goes by its day alone. Repeated rows count once;
where rows of one click_id differ, the least by (ts, arrived_at, kind, value) counts. An empty table gives no rows.
Other columns are not read, whatever their names; an hour may be negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kindred.llm.common import load, materialize, scratch_path

HOUR = 3_600_000_000
DAY = 24 * HOUR
SHIFT = 1_000_000 * DAY
#: After every time that a timestamp can hold, shifted.
BEYOND = 4 * 10**17
RECORD = "hour long, click_id long, n_rows long, cents long, record string, kind string"
_PARTIAL = "pane_kind string, pane_hour long, part int, kind string, hour long, click_id long, n long, cents long"
#: Panes that a map task holds before it hands them on.
HELD = 50_000


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, the same in every session time zone."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day * DAY + F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * 60_000_000 + second


def cut(clicks: DataFrame, batches: int = 12) -> DataFrame:
    """click_id, kind, event (microseconds), hour, cents, batch: each click once, with its batch from 0."""
    rows = clicks.filter(F.col("ts").isNotNull()).select(
        "click_id", F.struct("ts", F.coalesce(F.col("arrived_at"), F.col("ts")).alias("arrived_at"), "kind", "value").alias("row")
    )
    rows = rows.groupBy("click_id").agg(F.min("row").alias("row"))
    day = F.date_diff(F.col("row.arrived_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    q = F.pmod(day, F.lit(batches))
    delay = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23
    value = F.col("row.value")
    amount = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.floor(value * 100 + 0.5))
    out = rows.select(
        "click_id", F.coalesce("row.kind", F.lit("none")).alias("kind"), (wall_micros(F.col("row.ts")) - (day - q) * DAY).alias("event"),
        F.coalesce(amount.cast("long"), F.lit(0)).alias("cents"), F.least(F.lit(batches - 1), q + F.greatest(F.lit(0), delay)).cast("int").alias("batch"),
    )
    return out.withColumn("hour", F.expr(f"(event - pmod(event, {HOUR})) div {HOUR}"))


def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per pane of a task's rows with part 0; other rows as they are."""
    schema = pa.schema([
        ("pane_kind", pa.string()), ("pane_hour", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("hour", pa.int64()),
        ("click_id", pa.int64()), ("n", pa.int64()), ("cents", pa.int64()),
    ])
    names, pane_key = schema.names, ["pane_kind", "pane_hour", "part", "kind", "hour"]
    held = None

    def handed(table: pa.Table) -> list[pa.RecordBatch]:
        return table.select(names).cast(schema).combine_chunks().to_batches()

    for batch in parts:
        table = pa.Table.from_batches([batch]).select(names)
        pane = pa.compute.equal(table["part"], 0)
        whole = table.filter(pa.compute.invert(pane))
        if whole.num_rows:
            yield from handed(whole)
        rows = table.filter(pane)
        rows = rows if held is None else pa.concat_tables([held, rows.cast(schema)])
        sums = rows.group_by(pane_key).aggregate([("click_id", "max"), ("n", "sum"), ("cents", "sum")])
        held = sums.rename_columns({"click_id_max": "click_id", "n_sum": "n", "cents_sum": "cents"}).select(names).cast(schema)
        if held.num_rows > HELD:
            yield from handed(held)
            held = None
    if held is not None and held.num_rows:
        yield from handed(held)


class Panes(StatefulProcessor):
    """The state of one pane; see the module."""

    def __init__(self, grace: int, close: int) -> None:
        self.grace, self.hold = grace, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, cents long, shown boolean")

    def at(self, hour: int, hours: int) -> int:
        """Milliseconds, shifted, of a time that lies hours after the hour's end."""
        return ((hour + 1 + hours) * HOUR + SHIFT) // 1000

    def out(self, key, n: int, cents: int, record: str) -> tuple:
        return (int(key[1]), -1, n, cents, record, key[0])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["hour", "click_id", "n_rows", "cents", "record", "kind"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, hour, part = key
        now = timerValues.getCurrentWatermarkInMs()
        if part:  # the sentinel, or late rows, which have no pane
            for late in rows:
                if part > 0 and now < self.at(int(late["hour"].max()), self.hold):
                    raise RuntimeError("a row is late by the batch's watermark and not by the query's")
                if part > 0:
                    late = late[["hour", "click_id", "n", "cents", "kind"]].rename(columns={"n": "n_rows"})
                    yield late.assign(record="late")[["hour", "click_id", "n_rows", "cents", "record", "kind"]]
            return
        if now >= self.at(hour, self.hold):
            raise RuntimeError(f"pane {kind} {hour} is closed by the query's watermark and not by the batch's")
        n = cents = 0
        for some in rows:
            n, cents = n + int(some["n"].sum()), cents + int(some["cents"].sum())
        old = self.totals.get()
        if old is None:
            due = self.at(hour, min(self.grace, self.hold))
            self.totals.update((n, cents, now >= due))
            self.handle.registerTimer(self.at(hour, self.hold) if now >= due else due)
            if now >= due:
                yield self.frame([self.out(key, n, cents, "emit")])
            return
        n, cents, shown = n + old[0], cents + old[1], old[2]
        self.totals.update((n, cents, shown))
        if shown:
            yield self.frame([self.out(key, old[0], old[1], "retract"), self.out(key, n, cents, "replace")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        n, cents, shown = self.totals.get()
        if not shown:
            yield self.frame([self.out(key, n, cents, "final" if now >= BEYOND // 1000 else "emit")])
        if now >= self.at(key[1], self.hold):
            self.totals.clear()
        else:
            self.totals.update((n, cents, True))
            self.handle.registerTimer(self.at(key[1], self.hold))

    def close(self) -> None:
        pass


def _session(spark: SparkSession, folder: str) -> SparkSession:
    """A session of its own for the settings that the query needs, which writes below folder."""
    session = spark.newSession()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        # A rename by the default manager starts processes that read links; a local rename replaces a file at once without.
        manager = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
        session.conf.set("spark.sql.streaming.checkpointFileManagerClass", manager)
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        # A start is one micro-batch: a store that stayed open after it would hold disk for nothing.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        # Half of a partition's small files; the file system's own checksums stay.
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    }.items():
        session.conf.set(key, value)
    return session


def revisions(clicks: DataFrame, batches: int = 12, grace: int = 2, close: int = 72, spread: int = 128) -> DataFrame:
    """batch, hour, click_id, n_rows, cents, record, kind: what each batch writes; see the module."""
    spark = clicks.sparkSession
    table = materialize(cut(clicks, batches), "clicks")
    latest = {r["batch"]: r["latest"] for r in table.groupBy("batch").agg(F.max("event").alias("latest")).collect()}
    folder = scratch_path(spark, "panes")
    session = _session(spark, folder)
    stored = "click_id long, kind string, event long, cents long, hour long"
    fed = session.read.schema(table.schema).parquet(table.scratch)
    watermark = None
    for number in range(batches + 1):
        # The sentinel: no kind, and a time only in the last batch. The run after that one gets a sentinel alone.
        mark = session.range(1).select(
            F.lit(None).cast("long").alias("click_id"), F.lit(None).cast("string").alias("kind"),
            F.lit(BEYOND - SHIFT if number == batches - 1 else None).cast("long").alias("event"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("hour"),
        )
        rows = fed.filter(F.col("batch") == number).select(*mark.columns)
        (rows.unionByName(mark) if number < batches else mark).write.mode("overwrite").parquet(f"{folder}/in/{number:03d}")
        _feed(session, f"{folder}/in/*", folder, stored, watermark, grace, close, spread)
        if number in latest:
            watermark = latest[number] if watermark is None else max(watermark, latest[number])
    written = spark.read.schema(f"{RECORD}, run int").option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return written.select(F.least(F.col("run"), F.lit(batches - 1)).cast("long").alias("batch"), "hour", "click_id", "n_rows", "cents", "record", "kind")


def _feed(session: SparkSession, path: str, folder: str, stored: str, watermark: int | None, grace: int, close: int, spread: int) -> None:
    """One start of the query over what is new below path; watermark: the greatest event time before it."""
    late = F.lit(False) if watermark is None else F.col("hour") <= watermark // HOUR - 1 - close
    part = F.when(F.col("kind").isNull(), -1).when(late, 1 + F.pmod(F.xxhash64("click_id"), F.lit(spread))).otherwise(0).cast("int")
    rows = session.readStream.schema(stored).parquet(path).withColumn("at", F.timestamp_micros(F.col("event") + SHIFT)).withWatermark("at", "0 seconds")
    rows = rows.withColumn("part", part)
    own = [F.when(F.col("part") == 0, F.col(c)).otherwise(none).alias(f"pane_{c}") for c, none in (("kind", ""), ("hour", 0))]
    rows = rows.select(*own, "part", "kind", "hour", "click_id", F.lit(1).cast("long").alias("n"), "cents").mapInArrow(summed, _PARTIAL)
    panes = rows.groupBy("pane_kind", "pane_hour", "part").transformWithStateInPandas(Panes(grace, close), RECORD, "Update", "EventTime")

    def put(found: DataFrame, run: int) -> None:
        found.repartition(session.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{folder}/out/run={run}")

    query = panes.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()


def _crc32(text: str) -> str:
    """DuckDB's expression for the CRC-32 of a text of ASCII characters."""
    byte = "list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda crc, b: {byte}), 4294967295::BIGINT)"


#: Running totals instead of state: a pane is published in the first batch that has it and finds it due.
ORACLE = f"""
WITH once AS (
  SELECT click_id, min(ROW(ts, coalesce(arrived_at, ts), kind, value)) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
days AS (
  SELECT click_id, r[1] AS ts, coalesce(r[3], 'none') AS kind, coalesce(floor(100 * r[4] + 0.5), 0)::BIGINT AS cents,
         date_diff('day', DATE '1970-01-01', CAST(r[2] AS DATE)) AS d, {_crc32("click_id::VARCHAR")} AS crc FROM once),
placed AS (
  SELECT click_id, kind, cents, epoch_us(ts) - (d - d % 12) * {DAY} AS event, least(11, d % 12 + greatest(0, crc % 30 - 23)) AS batch FROM days),
rows_ AS (SELECT *, CAST(floor(event / {HOUR}.0) AS BIGINT) AS hour FROM placed),
runs AS (SELECT b AS batch, (SELECT max(event) FROM rows_ WHERE rows_.batch < b) AS w FROM range(12) t(b)),
marked AS (SELECT x.*, coalesce(w >= (hour + 73) * {HOUR}, false) AS late FROM rows_ x JOIN runs USING (batch)),
sums AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM marked WHERE NOT late GROUP BY ALL),
due AS (SELECT kind, hour, min(s.batch) AS first_batch,
               (SELECT min(r.batch) FROM runs r WHERE r.w >= (s.hour + 3) * {HOUR}) AS due_batch FROM sums s GROUP BY kind, hour),
emitted AS (SELECT kind, hour, greatest(first_batch, due_batch) AS e FROM due WHERE due_batch IS NOT NULL),
running AS (
  SELECT *, sum(n) OVER p AS total_n, sum(c) OVER p AS total_c FROM sums WINDOW p AS (PARTITION BY kind, hour ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id, 1::BIGINT AS n_rows, cents, 'late' AS record, kind FROM marked WHERE late
UNION ALL
SELECT e, hour, -1, sum(n)::BIGINT, sum(c)::BIGINT, 'emit', kind FROM sums JOIN emitted USING (kind, hour) WHERE batch <= e GROUP BY e, hour, kind
UNION ALL
SELECT batch, hour, -1, (total_n - n)::BIGINT, (total_c - c)::BIGINT, 'retract', kind FROM running JOIN emitted USING (kind, hour) WHERE batch > e
UNION ALL
SELECT batch, hour, -1, total_n::BIGINT, total_c::BIGINT, 'replace', kind FROM running JOIN emitted USING (kind, hour) WHERE batch > e
UNION ALL
SELECT 11, hour, -1, sum(n)::BIGINT, sum(c)::BIGINT, 'final', kind FROM sums ANTI JOIN emitted USING (kind, hour) GROUP BY hour, kind
"""


def op11_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(load(spark, sf_dir, "clicks"))
