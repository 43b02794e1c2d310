"""Incremental usage counts over the append-only prediction log (US8).

``readStream`` -> event time cast to ``timestamp`` (session zone UTC) ->
``withWatermark(ts, 1 day)`` -> ``groupBy(window(ts, 1 day), mode,
risk_level).count()`` in ``update`` mode. Each micro-batch's updated rows
are written by ``foreachBatch`` to their own folder (``batch_id=<id>``,
overwrite) so a replayed batch rewrites the same files; the current answer
is the newest row per key. With no row later than the watermark this
equals the batch aggregate; rows more than a day late are dropped by the
watermark, as streaming semantics require.

``run_accounted`` is the form that loses no row: each micro-batch adds its own
daily counts, and rows it may not count (their day was closed by an earlier
batch, or they have no time) go to a side output with the reason. What a batch
read, counted and put aside is observed while it is written and kept beside it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.fixtures import PREDICTION_LOG


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "riskframe", name, uuid.uuid4().hex)


def log_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The prediction-log projection over an events stream (or table)."""
    return spark.sql(PREDICTION_LOG, events=events)


def utc_instant(df: DataFrame, ts: str = "ts"):
    """The event time as an instant, independent of the session time zone:
    a naive ``timestamp_ntz`` is read as UTC wall-clock time."""
    from pyspark.sql.types import TimestampNTZType
    c = F.col(ts)
    if not isinstance(df.schema[ts].dataType, TimestampNTZType):
        return c
    sec = (F.second(c) + F.date_format(c, "SSSSSS").cast("int") / F.lit(1e6)).cast("decimal(8,6)")
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), sec, F.lit("UTC"))


def daily_counts_stream(log_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Windows are UTC days whatever the session time zone."""
    return (log_stream.withColumn("ts", utc_instant(log_stream)).withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day").alias("w"), "mode", "risk_level")
            .agg(F.count(F.lit(1)).alias("n")))


def _one_file(counts: DataFrame) -> DataFrame:
    """Counts for one file, moved by a shuffle: coalesced, all partitions of the
    aggregation, with their state, would run inside one task."""
    return counts.repartition(1)


def _writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # updated groups only: at most days x modes x risk levels rows, so
        # one file per batch (no swarm of empty shuffle-partition files)
        (_one_file(batch.select(F.col("w.start").alias("window_start"), "mode", "risk_level", "n"))
         .write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}")))
    return write


def run_available_now(spark: SparkSession, source: str, schema, out: str | None = None,
                      checkpoint: str | None = None, watermark: str = "1 day",
                      glob: str | None = None) -> str:
    """Process everything available under the folder ``source`` (files
    matching ``glob``) and stop. Returns the output folder. Restarting with
    the same checkpoint resumes where the last run stopped."""
    root = scratch_dir(spark, "usage_stream")
    out = out or os.path.join(root, "out")
    checkpoint = checkpoint or os.path.join(root, "checkpoint")
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    events = reader.parquet(source)
    agg = daily_counts_stream(log_from_events(spark, events), watermark)
    q = (agg.writeStream.outputMode("update").foreachBatch(_writer(out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """Current counts: the newest batch's value per (day, mode, risk)."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy("window_start", "mode", "risk_level").agg(
        F.max_by("n", "batch_id").alias("n"))
    from ..operators.usage import utc_day
    return latest.select(utc_day(F.col("window_start"), is_ntz=False).alias("day"), "mode", "risk_level",
                         F.col("n").cast("long").alias("n"))


# ------------------------------------------------------------ accounted form

COUNTS, ASIDE, AUDIT = "counts", "aside", "audit"


def _closed_until(spark: SparkSession, out: str, batch_id: int, delay: str):
    """Event time below which days are closed for this batch: the latest of
    the batches before it, less the delay; None before the first. A replayed
    batch looks at the same earlier batches and decides alike."""
    if batch_id == 0:
        return None
    earlier = spark.read.parquet(os.path.join(out, AUDIT)).filter(F.col("batch_id") < batch_id)
    latest = earlier.agg(F.max("latest")).first()[0]
    return None if latest is None else F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {delay}")


def _accounting_writer(out: str, delay: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed = _closed_until(spark, out, batch_id, delay)
        rows = batch.withColumn("ts", utc_instant(batch))
        end = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 86400) + 1) * 86400)      # of the row's UTC day
        late = F.lit(False) if closed is None else end <= closed
        rows = rows.withColumn("reason", F.when(F.col("ts").isNull(), "undated").when(late, "late")).persist()
        try:
            seen = Observation(f"usage-{batch_id}")
            counted = rows.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count("reason").alias("aside"),
                                   F.unix_micros(F.max("ts")).alias("latest")).filter("reason is null")
            start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 86400) * 86400).alias("window_start")
            folder = lambda kind: os.path.join(out, kind, f"batch_id={batch_id}")
            # days x modes x risk levels rows at most: one file per batch
            _one_file(counted.groupBy(start, "mode", "risk_level").agg(F.count(F.lit(1)).alias("n"))).write.mode(
                "overwrite").parquet(folder(COUNTS))
            rows.filter("reason is not null").write.mode("overwrite").parquet(folder(ASIDE))
            figures = seen.get
            spark.createDataFrame([(figures["rows_in"], figures["aside"], figures["latest"])],
                                  "rows_in long, aside long, latest long").coalesce(1).write.mode(
                "overwrite").parquet(folder(AUDIT))
        finally:
            rows.unpersist()
    return write


def run_accounted(spark: SparkSession, source: str, schema, out: str | None = None, checkpoint: str | None = None,
                  delay: str = "1 day", glob: str | None = None, max_files: int | None = None) -> str:
    """Like ``run_available_now``, with every row counted or put aside. Returns
    the output folder with ``counts``, ``aside`` and ``audit``, each by batch."""
    root = scratch_dir(spark, "usage_accounted")
    out = out or os.path.join(root, "out")
    reader = spark.readStream.schema(schema)
    for option, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", max_files)):
        if value:
            reader = reader.option(option, value)
    q = (log_from_events(spark, reader.parquet(source)).writeStream.foreachBatch(_accounting_writer(out, delay))
         .option("checkpointLocation", checkpoint or os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_accounted(spark: SparkSession, out: str) -> DataFrame:
    """Counts per (day, mode, risk level): the sum over all batches."""
    from ..operators.usage import utc_day
    return spark.read.parquet(os.path.join(out, COUNTS)).groupBy("window_start", "mode", "risk_level").agg(
        F.sum("n").alias("n")).select(utc_day(F.col("window_start"), is_ntz=False).alias("day"), "mode", "risk_level", "n")


def audit(spark: SparkSession, out: str) -> DataFrame:
    """One row: rows read, counted, and put aside as late or undated. Read and
    counted rows come from separate outputs, so that they can be compared."""
    read = spark.read.parquet(os.path.join(out, AUDIT)).agg(F.sum("rows_in").alias("rows_in"))
    counted = spark.read.parquet(os.path.join(out, COUNTS)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    aside = spark.read.parquet(os.path.join(out, ASIDE)).agg(
        F.count(F.when(F.col("reason") == "late", 1)).alias("late"), F.count(F.when(F.col("reason") == "undated", 1)).alias("undated"))
    return read.withColumn("_k", F.lit(1)).join(counted.withColumn("_k", F.lit(1)), "_k").join(
        aside.withColumn("_k", F.lit(1)), "_k").drop("_k")
