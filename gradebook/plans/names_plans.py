"""Name parsing over ``part`` (B12 B13 B10): each part stands for a model checkpoint id
``<brand>/<name>-<size>b`` evaluated on the data set ``p_type``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..session import table

RUN_TIME = "2025-08-13 10:30:37"


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter count from the model id, alias resolution and the evaluator's run name."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    model_id = F.concat(F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"),
                        F.lit("-"), F.col("p_size").cast("string"), F.lit("b"))
    staged = p.select("p_partkey", "p_type", model_id.alias("model_id"))
    return staged.select(
        "p_partkey", "model_id",
        names.resolve_alias("model_id").alias("resolved_id"),
        names.param_count("model_id").alias("param_count"),
        names.run_name(None, "model_id", F.lower("p_type"),
                       F.to_timestamp(F.lit(RUN_TIME))).alias("run_name"))
