"""Registry of the plans run by the driver and the benchmark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_plans as evp
from . import rollup_plans as rup
from . import sampling_plans as smp
from . import grpo_plans as gp
from . import records_plans as rcp
from . import boxes_plans as bxp
from . import math_plans as mp
from . import detection_plans as dtp
from . import probe_plans as pbp
from . import streaming_plans as stp
from . import names_plans as nmp
from . import library_plans as lib

Plan = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Plan]:
    q: dict[str, Plan] = {
        "lang_marker_accuracy": evp.lang_marker_accuracy,
        "confusion_matrix": evp.confusion,
        "class_accuracy": evp.class_accuracy,
        "language_report": evp.language_report,
        "running_accuracy": evp.running_accuracy_by_source,
        "batch_accuracy": evp.batch_accuracy_by_source,
        "predictions_file_round_trip": evp.predictions_file_round_trip,
        "checkpoint_curve": rup.checkpoint_curve,
        "best_checkpoint": rup.best_checkpoint,
        "forgetting_curve": rup.forgetting_curve,
        "result_files_rollup": rup.result_files_rollup,
        "result_tree_rollup": rup.result_tree_rollup,
        "step_dir_curves": rup.step_dir_curves,
        "missing_run_report": rup.missing_run_report,
        "shuffled_documents": smp.shuffled_documents,
        "validation_split": smp.validation_split,
        "grouped_sample_stream": smp.grouped_sample_stream,
        "repeated_sample_stream": smp.repeated_sample_stream,
        "incomplete_source_groups": smp.incomplete_source_groups,
        "rollout_advantages": gp.rollout_advantages,
        "step_metrics": gp.step_metrics,
        "logged_metrics": gp.logged_metrics,
        "token_row_stats": gp.token_row_stats,
        "token_loss_summary": gp.token_loss_summary,
        "sft_records": rcp.sft_records,
        "rl_examples": rcp.rl_examples,
        "conversation_prompts": rcp.conversation_prompts,
        "cot_records": rcp.cot_records,
        "box_rewards": bxp.box_rewards,
        "tile_plans": bxp.tile_plans,
        "image_token_prompts": bxp.image_token_prompts,
        "math_grades": mp.math_grades,
        "detection_pairs": dtp.detection_pairs,
        "annotation_filter": dtp.annotation_filter,
        "images_with_all_categories": dtp.images_with_all_categories,
        "detection_matches": dtp.detection_matches,
        "detection_precision": dtp.detection_precision,
        "detection_recall": dtp.detection_recall,
        "detection_summary": dtp.detection_summary,
        "detection_summary_all_categories": dtp.detection_summary_all_categories,
        "keypoint_summary": dtp.keypoint_summary,
        "scene_overlaps": dtp.scene_overlaps,
        "centroid_probe": pbp.centroid_probe,
        "attention_pooling": pbp.attention_pooling,
        "attentive_pooler": pbp.attentive_pooler,
        "probe_cross_entropy": pbp.probe_cross_entropy,
        "logistic_probe_epochs": pbp.logistic_probe_epochs,
        "stream_checkpoint_accuracy": stp.stream_checkpoint_accuracy,
        "stream_metric_flush": stp.stream_metric_flush,
        "stream_result_pickup": stp.stream_result_pickup,
        "stream_closed_windows": stp.stream_closed_windows,
        "stream_logged_metrics": stp.stream_logged_metrics,
        "model_names": nmp.model_names,
    }
    return q | lib.PLANS
