"""Structured Streaming forms of three roll-ups (K1-K3).

The reference has no streams; these are stream versions of its loops:

* K1 – running accuracy: per-experiment, per-day windowed counts (no watermark);
* K2 – metric flush: tumbling-window mean of each metric name;
* K3 – new-result pickup: a file-source stream over result CSV files, folding each
  micro-batch into the best checkpoint per experiment.

Every stream writes its micro-batches with ``foreachBatch`` (update mode) to a table in
the shared checkpoint folder, with its streaming checkpoint next to it, so a restarted
query resumes where it stopped. The final answer is the latest version of each key – a
``max_by`` over batch ids, computed by Spark, never collected on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

DAY_MICROS = 86_400_000_000


def utc_instant(ts_ntz: Column) -> Column:
    """A ``TIMESTAMP_NTZ`` read as a UTC wall-clock time → ``TIMESTAMP`` (independent of
    the session time zone; watermarks need ``TIMESTAMP``)."""
    micros = (F.unix_date(F.to_date(ts_ntz)).cast("long") * F.lit(DAY_MICROS)
              + F.hour(ts_ntz).cast("long") * F.lit(3_600_000_000)
              + F.minute(ts_ntz).cast("long") * F.lit(60_000_000)
              + (F.date_part(F.lit("SECOND"), ts_ntz) * F.lit(1_000_000)).cast("long"))
    return F.timestamp_micros(micros)


def epoch_unit(ts: Column, unit_micros: int) -> Column:
    """Whole ``unit`` periods since 1970-01-01 of a ``TIMESTAMP`` (zone independent)."""
    return F.floor(F.unix_micros(ts) / F.lit(unit_micros)).cast("long")


def read_table_stream(spark: SparkSession, sf_dir: str, name: str,
                      schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a table that is one file or a folder of part files."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern, the path may name a file as well as a folder.
    return reader.load(f"{sf_dir.rstrip('/')}/{name}[.]parquet")


def run_updates(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run an update-mode stream to the end of its input (``availableNow``), appending
    each micro-batch (tagged with its batch id) to a table in the checkpoint folder;
    return the latest row per key."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    out, ckpt = f"{base}/table", f"{base}/_checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    written = spark.read.parquet(out)
    cols = [c for c in written.columns if c not in (*keys, "_batch")]
    latest = written.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.col("_batch")).alias("_r"))
    return latest.select(*keys, "_r.*")


def streaming_accuracy(events: DataFrame, exp: str = "event_type", threshold: float = 10.0,
                       window: str = "1 day") -> DataFrame:
    """K1: per experiment and day window: samples, correct samples (value above the
    threshold). Same aggregate as the batch curve. No watermark: files of a finished source
    come in any order of event time, and none of their rows may be dropped as late."""
    ev = events.select(F.col(exp).alias("exp"), utc_instant(F.col("ts")).alias("t"),
                       (F.col("value") > F.lit(threshold)).alias("correct"))
    return (ev.groupBy(F.window("t", window).alias("w"), "exp")
            .agg(F.count(F.lit(1)).alias("total_samples"),
                 F.count_if("correct").alias("correct_predictions")))


def metric_flush(metrics: DataFrame, name: str, value: str, ts: str,
                 window: str = "1 hour") -> DataFrame:
    """K2: tumbling-window mean of every metric name (no row is late, as in K1)."""
    m = metrics.select(F.col(name).alias("name"), F.col(value).alias("value"),
                       utc_instant(F.col(ts)).alias("t"))
    return (m.groupBy(F.window("t", window).alias("w"), "name")
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")))


def result_pickup(spark: SparkSession, results_dir: str, schema: T.StructType) -> DataFrame:
    """K3: stream the result CSV files as they arrive (file source, partition columns in
    the schema) – the roll-up runs as a streaming aggregation."""
    return (spark.readStream.option("header", True).schema(schema)
            .option("recursiveFileLookup", False).csv(results_dir))
