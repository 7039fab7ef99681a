"""Evaluation plans over the driver tables (survey build steps 1-4).

``documents`` stands in for a predictions table: the ground truth is the class name of
the document's language and the prediction is the first language marker mentioned in
the text (operator C1), exactly as the evaluator turns generated text into a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import resolve_alias
from ..functions.text import first_mentioned_class
from ..operators import evaluation as ev
from ..session import table

# The class vocabulary of the language-marker task, in class order
# (label 0..3); each language's class name is its most frequent function word.
LANG_CLASSES = [("en", "the"), ("fr", "le"), ("de", "der"), ("es", "el")]
CLASS_NAMES = [name for _, name in LANG_CLASSES]

# Display names used by the alias-resolution plan.
LANG_ALIASES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def lang_class(lang_col: str = "lang"):
    """Language → class name through a literal map (no join needed)."""
    m = F.create_map(*[x for lang, name in LANG_CLASSES for x in (F.lit(lang), F.lit(name))])
    return F.lower(F.element_at(m, F.col(lang_col)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → (doc_id, source, lang, ground_truth, prediction)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.select(
        "doc_id", "source", "lang",
        F.coalesce(lang_class("lang"), F.lit("")).alias("ground_truth"),
        first_mentioned_class("text", CLASS_NAMES).alias("prediction"),
    )


def lang_marker_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 1 (C1 D1 E1 G1): marker accuracy per language, ordered by language."""
    return ev.accuracy(predictions(spark, sf_dir), ["lang"]).orderBy("lang")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 2 (E13): long-form confusion matrix ground truth × prediction."""
    return ev.confusion_matrix(predictions(spark, sf_dir))


def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 2 (E13): per-class accuracy."""
    return ev.per_class_accuracy(predictions(spark, sf_dir))


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 2 (B10 + E1): accuracy keyed by the alias-resolved language name."""
    preds = predictions(spark, sf_dir).withColumn(
        "language", resolve_alias(F.upper(F.col("lang")), LANG_ALIASES))
    return ev.accuracy(preds, ["language"])


def running_accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 3 (F1): running accuracy per source in doc_id order."""
    out = ev.running_accuracy(predictions(spark, sf_dir), ["source"], "doc_id")
    return out.select("source", "doc_id", "position", "running_total", "running_correct",
                      "running_accuracy")


def batch_accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 3 (F9 + E1): accuracy of consecutive batches of 8 documents per source."""
    out = ev.batch_accuracy(predictions(spark, sf_dir), ["source"], "doc_id", batch_size=8)
    return out.select("source", "batch", "total_samples", "correct_predictions",
                      "accuracy_percent")


def predictions_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: write the prediction file (ground truth, prediction, whole generated text)
    to the shared checkpoint folder and read it back; each text is fingerprinted so the
    round trip of multi-line, quoted texts is checked byte for byte."""
    from ..session import scratch_path
    from ..sources import results as rs

    docs = table(spark, sf_dir, "documents").select("lang", "text")
    preds = docs.select(
        F.coalesce(lang_class("lang"), F.lit("")).alias("ground_truth"),
        first_mentioned_class("text", CLASS_NAMES).alias("prediction"),
        F.col("text").alias("generated_text"))
    path = scratch_path(spark, "predictions")
    rs.write_predictions(preds, path)
    back = rs.read_predictions(spark, path)
    return back.select("ground_truth", "prediction",
                       F.md5("generated_text").alias("text_md5"),
                       F.length("generated_text").alias("text_chars"))
