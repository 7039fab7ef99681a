"""Structured Streaming plans (survey build step 16: K1 K2 K3).

Each plan streams a driver table (file source, ``availableNow``) through a stateful
aggregation, writes the micro-batches to the shared checkpoint folder and returns the
final state per key as a batch DataFrame.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluation as ev
from ..session import scratch_path, table
from ..sources import results as rs
from ..streaming import streams as st
from ..streaming import windows as win
from .grpo_plans import LOGGING_STEPS, step_metrics
from .rollup_plans import checkpoint_curve

HOUR_MICROS = 3_600_000_000


def stream_checkpoint_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: per-day accuracy per experiment from an event stream (no watermark)."""
    events = st.read_table_stream(spark, sf_dir, "events", st.EVENTS_SCHEMA)
    final = st.run_updates(st.streaming_accuracy(events), ["w", "exp"], "accuracy")
    return final.select(
        "exp", st.epoch_unit(F.col("w.start"), st.DAY_MICROS).alias("step"),
        "total_samples", "correct_predictions",
        ev.percent(F.col("correct_predictions"), F.col("total_samples")).alias("accuracy_percent"))


def stream_metric_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: hourly tumbling-window mean of each metric (event type → value)."""
    events = st.read_table_stream(spark, sf_dir, "events", st.EVENTS_SCHEMA)
    final = st.run_updates(st.metric_flush(events, "event_type", "value", "ts"), ["w", "name"],
                           "metrics")
    return final.select(st.epoch_unit(F.col("w.start"), HOUR_MICROS).alias("hour"), "name", "n",
                        F.round("mean_value", 6).alias("mean_value"))


RESULT_SCHEMA = T.StructType([
    T.StructField("total_samples", T.LongType()),
    T.StructField("correct_predictions", T.LongType()),
    T.StructField("accuracy_percent", T.DoubleType()),
    T.StructField("exp", T.StringType()),
    T.StructField("step", T.LongType()),
])


def stream_result_pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: result files are picked up by a file-source stream and folded into the best
    checkpoint per experiment (streaming aggregation, update mode)."""
    path = scratch_path(spark, "result-stream-src")
    rs.write_accuracy(checkpoint_curve(spark, sf_dir), path)
    stream = st.result_pickup(spark, path, RESULT_SCHEMA)
    best = ev.best_per_experiment(stream)
    final = st.run_updates(best, ["exp"], "best")
    return final.select("exp", "step", "accuracy_percent", "total_samples",
                        "correct_predictions")


#: Epoch second of step 0 in the stream of step metrics; a multiple of ``LOGGING_STEPS``.
STEP_0 = 1_704_067_200
#: Days (of January 2024) that begin a new arrival of the event stream.
ARRIVALS = (8, 16, 24)


def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 with event time: events arrive in four files by date, those of every fiftieth user in
    a fifth one; days close two days after their end. Per day and experiment the closed counts
    and the late rows."""
    events = table(spark, sf_dir, "events").select(*[f.name for f in st.EVENTS_SCHEMA])
    slow = F.col("user_id") % 50 == 0
    day = F.dayofmonth("ts")
    cuts = [1, *ARRIVALS, 32]
    parts = [events.where(~slow & (day >= a) & (day < b)) for a, b in zip(cuts, cuts[1:])]
    folder = scratch_path(spark, "stream-closed")
    win.stage_arrivals([*parts, events.where(slow)], "ts", f"{folder}/arrivals")
    stream = spark.readStream.schema(st.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/arrivals")
    correct = (F.col("value") > 10.0).cast("int")
    found, _ = win.run_appends(win.closing_windows(
        stream, F.col("event_type"), st.utc_instant(F.col("ts")), correct, timedelta(days=1),
        timedelta(days=2), shards=4), folder)
    closed, late = (win.combined(found, kind) for kind in ("closed", "late"))
    late = late.select("key", "window_ms", F.col("n").alias("late_samples"),
                       F.col("total").alias("late_total"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return closed.join(late, ["key", "window_ms"], "full").select(
        F.col("key").alias("exp"), F.floor(F.col("window_ms") / 86_400_000).alias("step"),
        whole("n").alias("total_samples"), whole("total").alias("correct_predictions"),
        whole("late_samples").alias("late_samples"), whole("late_total").alias("late_correct"))


def stream_logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the step metrics as a stream (step k happens k seconds after ``STEP_0``): a metric's
    buffer is averaged, flushed and cleared after every ``LOGGING_STEPS`` steps."""
    metrics = step_metrics(spark, sf_dir).select(
        F.timestamp_seconds(F.col("step") + STEP_0).alias("t"), "name", "value")
    folder = scratch_path(spark, "stream-buffers")
    win.stage_arrivals([metrics], "t", f"{folder}/arrivals")
    stream = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/arrivals")
    found, _ = win.run_appends(win.closing_windows(
        stream, F.col("name"), F.col("t"), F.col("value"), timedelta(seconds=LOGGING_STEPS),
        timedelta(0)), folder)
    return win.combined(found).select(
        F.floor((F.col("window_ms") / 1000 - STEP_0) / LOGGING_STEPS).alias("log_window"),
        F.col("key").alias("name"), F.round(F.col("total") / F.col("n"), 6).alias("value"))
