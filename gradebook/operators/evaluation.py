"""Evaluation roll-ups: accuracy, running and batch accuracy, confusion matrix, best
checkpoint, best epoch and the forgetting report (E1, E11-E14, F1, F9, G1-G3).

All of them are partial-then-final aggregations (``groupBy().agg``), so a hot group is
pre-aggregated on the map side before the shuffle; ordered operators use the blocked
positions of :mod:`gradebook.operators.ranking` instead of a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MODEL_ERROR, UNKNOWN
from .ranking import numeric_block, running_totals


def percent(correct: Column, total: Column, digits: int | None = 2) -> Column:
    """``100 * correct / total`` or 0 when total is 0 (the evaluator's rule)."""
    value = F.when(total > 0, F.lit(100.0) * correct / total).otherwise(F.lit(0.0))
    return F.round(value, digits) if digits is not None else value


def _valid(pred: Column) -> Column:
    return pred != F.lit(MODEL_ERROR)


def accuracy(df: DataFrame, by: Sequence[str], gt: str = "ground_truth",
             pred: str = "prediction", digits: int | None = 2) -> DataFrame:
    """Total / correct / accuracy per group.

    Rows predicted as ``error_empty_input_ids`` are left out of both counts; ``unknown``
    counts as wrong; the accuracy is 0 when a group has no valid row.
    """
    p, g = F.col(pred), F.col(gt)
    valid = _valid(p)
    out = df.groupBy(*by).agg(
        F.count_if(valid).alias("total_samples"),
        F.count_if(valid & (p == g)).alias("correct_predictions"),
        F.count_if(p == F.lit(UNKNOWN)).alias("unknown_predictions"),
    )
    return out.withColumn(
        "accuracy_percent", percent(F.col("correct_predictions"), F.col("total_samples"), digits))


def running_accuracy(df: DataFrame, by: Sequence[str], seq: str, gt: str = "ground_truth",
                     pred: str = "prediction", block_width: int = 4096) -> DataFrame:
    """cumulative correct / total after each row, in ``seq`` order per ``by``.

    ``seq`` must be a non-negative number; rows are grouped into blocks of
    ``block_width`` consecutive ``seq`` values so no task holds a whole group.
    """
    p, g = F.col(pred), F.col(gt)
    valid = _valid(p)
    out = running_totals(
        df, by, [seq], numeric_block(seq, block_width),
        {"running_total": valid.cast("long"),
         "running_correct": (valid & (p == g)).cast("long")},
        rank_col="position", levels=2)
    return out.withColumn(
        "running_accuracy", percent(F.col("running_correct"), F.col("running_total")))


def batch_accuracy(df: DataFrame, by: Sequence[str], seq: str, batch_size: int,
                   gt: str = "ground_truth", pred: str = "prediction",
                   block_width: int = 4096) -> DataFrame:
    """F9 + E1: fixed-size consecutive batches in ``seq`` order (last may be short)."""
    ranked = running_totals(df, by, [seq], numeric_block(seq, block_width), {},
                            rank_col="position", levels=2)
    batched = ranked.withColumn(
        "batch", F.floor((F.col("position") - 1) / F.lit(batch_size)).cast("long"))
    return accuracy(batched, [*by, "batch"], gt, pred)


def confusion_matrix(df: DataFrame, gt: str = "ground_truth", pred: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """Long-form confusion matrix ``(ground_truth, prediction, n)``."""
    return df.groupBy(*by, gt, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class_accuracy(df: DataFrame, gt: str = "ground_truth",
                       pred: str = "prediction") -> DataFrame:
    """Accuracy per ground-truth class (recall of each class)."""
    return accuracy(df, [gt], gt, pred)


def best_per_experiment(results: DataFrame, exp: str = "exp", step: str = "step",
                        acc: str = "accuracy_percent",
                        nullable: Sequence[str] = ("total_samples", "correct_predictions"),
                        extra: Sequence[str] = ()) -> DataFrame:
    """Per experiment, the row with the highest accuracy, earliest step on ties.

    Nullable columns take the first non-null value in the same order (as pandas
    ``groupby().first()`` does). Rows without an accuracy take no part. One partial
    aggregation, skew-safe.
    """
    results = results.where(F.col(acc).isNotNull())
    order = F.struct((-F.col(acc)).alias("a"), F.col(step).alias("s"))
    aggs = [F.min_by(F.col(step), order).alias(step), F.max(F.col(acc)).alias(acc)]
    for c in [*nullable, *extra]:
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c))
    return results.groupBy(exp).agg(*aggs)


def best_epoch(metrics: DataFrame, epoch: str = "epoch", acc: str = "val_accuracy",
               by: Sequence[str] = ()) -> DataFrame:
    """First epoch with the highest accuracy above 0 (strict improvement from 0.0)."""
    order = F.struct(F.col(acc).alias("a"), (-F.col(epoch)).alias("e"))
    return (metrics.filter(F.col(acc) > 0).groupBy(*by)
            .agg(F.max_by(F.col(epoch), order).alias("best_epoch"),
                 F.max(F.col(acc)).alias("best_accuracy")))


def forgetting_report(results: DataFrame, model: str, dataset: str, baseline_model: str,
                      acc: str = "accuracy_percent") -> DataFrame:
    """Accuracy per (model, data set) next to the baseline model's accuracy.

    The baseline rows are one per data set; they are joined on the data set key.
    """
    base = (results.filter(F.col(model) == F.lit(baseline_model))
            .groupBy(dataset).agg(F.max(acc).alias("baseline_accuracy")))
    return (results.join(base, on=dataset, how="left")
            .withColumn("accuracy_change", F.col(acc) - F.col("baseline_accuracy")))


def change_since_first(results: DataFrame, exp: str, step: str,
                       acc: str = "accuracy_percent", digits: int = 2) -> DataFrame:
    """E14 over a curve: accuracy next to the experiment's first checkpoint (the
    zero-shot point), and the difference. One partial aggregation + one equi-join."""
    base = results.groupBy(exp).agg(F.min_by(F.col(acc), F.col(step)).alias("baseline_accuracy"))
    return (results.join(base, on=exp, how="inner")
            .withColumn("accuracy_change",
                        F.round(F.col(acc) - F.col("baseline_accuracy"), digits)))
