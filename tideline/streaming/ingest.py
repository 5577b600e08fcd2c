"""Incremental ingestion with Structured Streaming.

Two streams read the landing folder, each with a checkpoint of its own: ``ingest_pools`` takes
up the records, ``keep_ledger`` keeps a state for each task (endpoint, source, window).  An epoch
writes a folder of its own, over whatever an earlier try of it has left, so a batch that is
replayed after a failure adds nothing.  What counts in the end (``ingested``) are the sound records of
the attempt that a task's ledger names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.checks import ValidationError, news_rule
from ..sources.io import landed_texts, pool_envelopes, pool_records, record_time, task_name

#: The state store that keyed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "pool string, status string, attempts long, row_count long, bad long, attempt string, file string, error string"
STATE = "status string, attempts long, row_count long, bad long, attempt string, file string, error string"


def one_each(envelopes: DataFrame) -> DataFrame:
    """Of equal envelopes of one file, one; rows meet only if there are such."""
    if envelopes.groupBy("attempt").count().where(F.col("count") > 1).isEmpty():
        return envelopes
    return envelopes.dropDuplicates(["attempt"])


def ingest_pools(spark: SparkSession, landing: str, out: str, checkpoint: str, lines: bool = True, after_write: Callable[[int], None] | None = None) -> None:
    """Take up newly landed pool files, once each: every record comes to ``records`` or, with its rule, to ``violations``.

    The checkpoint makes it resumable: a second run over the same files adds nothing.  Texts that are no envelope go to
    ``unreadable``.  What comes out is counted against what the envelopes hold; a difference is an error.
    ``after_write`` is called when an epoch is written and not yet marked as done (tests stop there).
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        at = lambda name: f"{out}/{name}/epoch={epoch}"
        envelopes = one_each(pool_envelopes(rows))
        pool_records(envelopes.where(~F.col("unreadable"))).withColumn("rule", news_rule()).write.mode("overwrite").partitionBy("rule").parquet(at("landed"))
        envelopes.select("file", "attempt", "unreadable", F.coalesce(F.size("records"), F.lit(0)).alias("n")).write.mode("overwrite").parquet(at("envelopes"))
        held = spark.read.parquet(at("envelopes")).where(~F.col("unreadable")).agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0))).first()[0]
        came = spark.read.schema("pool string, rule string").parquet(at("landed")).count()
        if held != came:
            raise ValidationError(f"epoch {epoch}: {held} records landed, {came} came out")
        if after_write:
            after_write(epoch)

    stream = landed_texts(spark.readStream, landing, lines)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


RECORDS = "pool string, attempt string, place int, endpoint string, ts string, title string, content string, source string, window_start timestamp_ntz, window_end timestamp_ntz, row_count long, n_records int, epoch int, rule string"


def epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What all epochs have written; no rows before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def landed(spark: SparkSession, out: str) -> DataFrame:
    """All records taken up, with the rule that they break (null: sound) and their epoch."""
    return epochs(spark, f"{out}/landed", RECORDS)


def records(spark: SparkSession, out: str) -> DataFrame:
    return landed(spark, out).where(F.col("rule").isNull()).drop("rule")


def violations(spark: SparkSession, out: str) -> DataFrame:
    return landed(spark, out).where(F.col("rule").isNotNull()).select("pool", "attempt", "place", "ts", "rule", "epoch")


def unreadable(spark: SparkSession, out: str) -> DataFrame:
    return epochs(spark, f"{out}/envelopes", "file string, attempt string, unreadable boolean, n int, epoch int").where("unreadable").select("file", "attempt", "epoch")


class Ledger(StatefulProcessor):
    """A task's state: the first attempt without a fault stays; until there is one, the last attempt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.task.get() if self.task.exists() else None
        status, attempts, kept = (old[0], old[1], tuple(old[2:])) if old else ("error", 0, None)
        seen = set()
        for r in sorted(rows, key=lambda r: (r["landed"], r["attempt"])):
            if r["attempt"] in seen:  # equal envelopes of a file are one attempt
                continue
            seen.add(r["attempt"])
            attempts += 1
            if status == "error":
                status, kept = r["status"], (r["row_count"], r["bad"], r["attempt"], r["file"], r["error"])
        self.task.update((status, attempts, *kept))
        yield Row(pool=key[0], status=status, attempts=attempts, row_count=kept[0], bad=kept[1], attempt=kept[2], file=kept[3], error=kept[4])

    def close(self) -> None:
        pass


def attempts(envelopes: DataFrame) -> DataFrame:
    """Each envelope's task and status: ``error`` with broken rules or another number of rows than announced, ``empty``, ``complete``."""
    n = F.coalesce(F.greatest(F.size("records"), F.lit(0)), F.lit(0))
    rules = F.filter(F.transform("records", lambda r: news_rule(record_time(F.col("endpoint"), r), r["content"], F.col("start_dt"), F.col("end_dt"), n, n)), lambda x: x.isNotNull())
    bad = F.coalesce(F.greatest(F.size(rules), F.lit(0)), F.lit(0))
    error = F.when(F.col("unreadable"), "unreadable").when(~F.col("row_count").eqNullSafe(n.cast("long")), "another number of rows").when(bad > 0, F.array_join(F.array_sort(F.array_distinct(rules)), ";"))
    pool = F.when(F.col("unreadable"), F.col("file")).otherwise(task_name())
    status = F.when(error.isNotNull(), "error").when(n == 0, "empty").otherwise("complete")
    return envelopes.select(pool.alias("pool"), "landed", "attempt", "file", status.alias("status"), n.cast("long").alias("row_count"), bad.cast("long").alias("bad"), error.alias("error"))


def keep_ledger(spark: SparkSession, landing: str, out: str, checkpoint: str, lines: bool = True, after_write: Callable[[int], None] | None = None) -> None:
    """Bring the ledger up to date with what has landed: a row for each task that got an attempt, by epoch.

    State is keyed by task and holds a few values for each; texts never come near it.  An unreadable text counts under its file.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/ledger/epoch={epoch}")
        if after_write:
            after_write(epoch)

    tried = attempts(pool_envelopes(landed_texts(spark.readStream, landing, lines)))
    states = tried.groupBy("pool").transformWithState(Ledger(), LEDGER, "Update", "None")
    states.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every task."""
    rows = epochs(spark, f"{out}/ledger", LEDGER + ", epoch int")
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "pool"]), "epoch").alias("t")
    return rows.groupBy("pool").agg(last).select("pool", "t.*")


def failed_or_missing(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Of the tasks to do (``endpoint``, ``source``, ``start_dt``, ``end_dt``) those without a faultless attempt, with the reason."""
    wanted = tasks.select(task_name().alias("pool")).distinct()
    left = wanted.join(states.select("pool", "status", "error"), "pool", "left").where(F.coalesce("status", F.lit("error")) == "error")
    return left.select("pool", F.coalesce("error", F.lit("missing")).alias("rule"))


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Sound records of the attempt that each task's ledger names: a task that landed again adds nothing."""
    named = ledger(spark, out).select("pool", "attempt")
    return records(spark, out).join(named, ["pool", "attempt"], "left_semi")


def dedupe_stream(rows: DataFrame, key: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First of the rows that repeat ``key`` within the watermark; state is bounded by the delay."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def attention_by_day(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mentions per source and day of event time, late rows within the delay counted."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("mentions"), F.sum("value").alias("total"))
