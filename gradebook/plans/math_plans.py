"""Maths answer grading over ``lineitem`` (survey build step 11: C7 C8 C9).

Each line yields a ground truth and a model answer in one of several written forms
(``\\frac{a}{b}``, ``a/b``, ``0.5``; boxed with braces, boxed with a space, bare), built
from the line's numbers; the grade is C9. The DuckDB twin restates the rules that these
forms meet; unit tests pin the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math_answer import grade_math
from ..session import table


def math_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    a = F.col("l_linenumber").cast("string")
    q = F.round("l_quantity", 0).cast("int").cast("string")
    truth = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("\\frac{"), a, F.lit("}{"), q,
                                                           F.lit("}")))
             .when(F.col("l_returnflag") == "N", F.concat(a, F.lit("/"), q))
             .otherwise(F.lit("0.5")))
    answer = (F.when(F.col("l_linestatus") == "O",
                     F.concat(F.lit("The answer is $\\boxed{\\frac"), a, q, F.lit("}$.")))
              .otherwise(F.concat(F.lit("so \\boxed "), a, F.lit("/"), q, F.lit("$ done"))))
    return li.select("l_orderkey", "l_linenumber", answer.alias("answer"), truth.alias("truth"))


def math_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 11: grade per line (C7 boxed extraction, C8 normalisation, C9 comparison)."""
    m = math_answers(spark, sf_dir)
    return m.select("l_orderkey", "l_linenumber", "answer", "truth",
                    grade_math(F.col("answer"), F.col("truth")).alias("grade"))
