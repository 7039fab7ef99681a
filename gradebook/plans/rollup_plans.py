"""Checkpoint roll-up plans over ``events`` (survey build steps 4-5).

``events`` stands in for per-checkpoint evaluation results: experiment = ``event_type``,
checkpoint step = day number (days since 1970-01-01), a sample is "correct" when its
``value`` is above 10. The curve, the best checkpoint and the change since the first
checkpoint are the evaluator's roll-ups (E1, E11, E14, G1, G2); the round trip through
CSV files exercises the result writers and readers (A3, A15, A1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..session import scratch_path, table
from ..sources import results as rs

CORRECT_ABOVE = 10.0


def checkpoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev_ = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return ev_.select(
        F.col("event_type").alias("exp"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("step"),
        (F.col("value") > F.lit(CORRECT_ABOVE)).alias("correct"),
    )


def checkpoint_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 4 (E1 + G1): accuracy per (exp, step), ordered by exp, step."""
    s = checkpoint_samples(spark, sf_dir)
    out = s.groupBy("exp", "step").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("correct").alias("correct_predictions"))
    out = out.withColumn("accuracy_percent",
                         ev.percent(F.col("correct_predictions"), F.col("total_samples")))
    return out.orderBy("exp", "step")


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 4 (E11 + G2): best step per exp (highest accuracy, earliest step on ties)."""
    best = ev.best_per_experiment(checkpoint_curve(spark, sf_dir))
    return best.orderBy(F.col("exp"), F.col("accuracy_percent").desc(), F.col("step"))


def forgetting_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 4 (E14): each checkpoint's accuracy next to its experiment's first checkpoint."""
    curve = checkpoint_curve(spark, sf_dir)
    out = ev.change_since_first(curve, "exp", "step")
    return out.select("exp", "step", "accuracy_percent", "baseline_accuracy",
                      "accuracy_change")


def result_files_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 5 (A3 A15 → read back → E11): write the curve as per-checkpoint CSV files in
    the shared checkpoint folder, read them back and pick the best checkpoint."""
    path = scratch_path(spark, "result-files")
    rs.write_accuracy(checkpoint_curve(spark, sf_dir), path)
    back = rs.read_results(spark, path)
    return ev.best_per_experiment(back).select(
        "exp", "step", "accuracy_percent", "total_samples", "correct_predictions")


def result_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 5 (A3 in the evaluator's layout → A1 tree scan → E11): write one accuracy CSV
    per checkpoint under ``<exp>/<n>_steps/``, walk the tree back and pick the best
    checkpoint per experiment."""
    base = scratch_path(spark, "result-tree")
    rs.write_result_tree(checkpoint_curve(spark, sf_dir), base)
    back = rs.scan_result_tree(spark, base)
    return ev.best_per_experiment(back).select(
        "exp", "step", "accuracy_percent", "total_samples", "correct_predictions")


def step_dir_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 5 (A2 + G1): every experiment directory of the written tree read with the
    one-level reader (``<x>_steps`` directly under the experiment directory)."""
    base = scratch_path(spark, "result-tree")
    rs.write_result_tree(checkpoint_curve(spark, sf_dir), base)
    out = rs.scan_step_dirs(spark, base)
    return out.select("exp", F.col("step").cast("long").alias("step"),
                      F.col("accuracy").alias("accuracy_percent"))


def missing_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep is every experiment × every daily checkpoint between the first and
    the last day of the table; finished runs are the checkpoints with results. Per
    experiment: expected, finished and missing runs (expected minus finished, an
    anti-join)."""
    from ..operators.records import missing_runs

    curve = checkpoint_curve(spark, sf_dir).select("exp", "step")
    span = curve.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))  # one row
    exps = curve.select("exp").distinct()
    expected = (exps.crossJoin(F.broadcast(span))
                .select("exp", F.explode(F.sequence("lo", "hi")).alias("step")))
    missing = missing_runs(expected, curve, ["exp", "step"])
    per_exp = lambda df, name: df.groupBy("exp").agg(F.count(F.lit(1)).alias(name))
    return (per_exp(expected, "expected_runs")
            .join(per_exp(curve, "finished_runs"), on="exp", how="left")
            .join(per_exp(missing, "missing_runs"), on="exp", how="left")
            .select("exp", "expected_runs",
                    F.coalesce("finished_runs", F.lit(0)).alias("finished_runs"),
                    F.coalesce("missing_runs", F.lit(0)).alias("missing_runs")))
