"""Reward functions as Column builders.

A reward function is ``f(columns) -> Column[double]``; the registry maps the names the
trainer is configured with to builders. User rewards can be plugged in as a
``pandas_udf`` returning double (see :func:`register_reward`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import first_mentioned_class, format_reward, format_reward_rec

RewardFn = Callable[..., Column]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classification_reward(content: Column | str, solution: Column | str,
                          class_names: Sequence[str], lower_solution: bool = False) -> Column:
    """1.0 when the first mentioned class equals the solution.

    The class found is lower-cased while the solution is compared as given (the trainer's
    behaviour); ``lower_solution=True`` gives the evaluator's rule instead.
    """
    sol = F.lower(_c(solution)) if lower_solution else _c(solution)
    hit = first_mentioned_class(content, class_names) == sol
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def box_iou_xyxy(a: Column, b: Column) -> Column:
    """IoU of two ``[x1, y1, x2, y2]`` integer boxes with the trainer's pixel rule.

    The overlap uses ``x2-1, y2-1`` and a **strict** ``<`` (a one-pixel overlap counts 0),
    then adds 1 back; areas are plain products. A zero union gives NULL.
    """
    ix1, iy1 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    ix2, iy2 = F.least(a[2] - 1, b[2] - 1), F.least(a[3] - 1, b[3] - 1)
    inter = F.when((ix1 < ix2) & (iy1 < iy2), (ix2 - ix1 + 1) * (iy2 - iy1 + 1)).otherwise(0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.try_divide(inter.cast("double"), union.cast("double"))


ANSWER_BLOCK = r"(?s)<answer>(.*?)</answer>"
QUAD = r"\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)]"


def iou_reward(content: Column | str, solution: Column | str) -> Column:
    """C5 as one Column: IoU between the first 4-integer list in the completion's first
    answer block and the JSON box in the solution's last answer block; any failure gives
    0.0. For large tables prefer :func:`with_iou_reward`, which stages the parsed boxes
    as columns so every regex and JSON parse runs once per row."""
    sol_blocks = F.regexp_extract_all(_c(solution), F.lit(ANSWER_BLOCK), 1)
    sol_box = F.from_json(F.trim(F.try_element_at(sol_blocks, F.lit(-1))), T.ArrayType(T.DoubleType()))
    answer = F.trim(F.regexp_extract(_c(content), ANSWER_BLOCK, 1))
    quad = F.array(*[F.regexp_extract(answer, QUAD, i).try_cast("double") for i in range(1, 5)])
    ok = _c(content).rlike(ANSWER_BLOCK) & answer.rlike(QUAD) & (F.size(sol_box) == 4)
    iou = box_iou_xyxy(quad, sol_box)
    return F.when(F.coalesce(ok, F.lit(False)), F.coalesce(iou, F.lit(0.0))).otherwise(F.lit(0.0))


def with_iou_reward(df: DataFrame, content: str, solution: str,
                    out: str = "iou_reward") -> DataFrame:
    """C5 on a DataFrame: parse both boxes once into columns, then compute the IoU.

    Staging keeps the expensive regex / JSON expressions from being duplicated by the
    many references inside the IoU arithmetic (Catalyst does not collapse projections
    when that would repeat a non-cheap expression).
    """
    blocks = F.regexp_extract_all(F.col(solution), F.lit(ANSWER_BLOCK), 1)
    staged = (df
              .withColumn("_sol_box", F.from_json(F.trim(F.try_element_at(blocks, F.lit(-1))),
                                                  T.ArrayType(T.DoubleType())))
              .withColumn("_ans", F.regexp_extract(F.col(content), ANSWER_BLOCK, 1))
              .withColumn("_ans_ok", F.col(content).rlike(ANSWER_BLOCK))
              .withColumn("_m", F.regexp_extract_all(F.trim(F.col("_ans")), F.lit(QUAD), 0))
              .withColumn("_q", F.try_element_at(F.col("_m"), F.lit(1))))
    nums = F.regexp_extract_all(F.col("_q"), F.lit(r"(\d+)"), 1)
    staged = staged.withColumn("_quad", F.transform(nums, lambda x: x.cast("double")))
    ok = (F.col("_ans_ok") & (F.size("_m") > 0) & (F.size("_sol_box") == 4))
    iou = box_iou_xyxy(F.col("_quad"), F.col("_sol_box"))
    return staged.withColumn(
        out, F.when(F.coalesce(ok, F.lit(False)), F.coalesce(iou, F.lit(0.0)))
        .otherwise(F.lit(0.0))).drop("_sol_box", "_ans", "_ans_ok", "_m", "_q", "_quad")


def _accuracy(class_names: Sequence[str]) -> RewardFn:
    def fn(content: Column | str, solution: Column | str, **_: Column) -> Column:
        return classification_reward(content, solution, class_names)
    return fn


def _format(content: Column | str, solution: Column | str | None = None, **_: Column) -> Column:
    return format_reward(content)


def _iou(content: Column | str, solution: Column | str, **_: Column) -> Column:
    return iou_reward(content, solution)


def _format_rec(braces: bool) -> RewardFn:
    def fn(content: Column | str, solution: Column | str | None = None, **_: Column) -> Column:
        return format_reward_rec(content, braces=braces)
    return fn


def select_reward(name: str, task: str | None = None, class_names: Sequence[str] = (),
                  customised: bool = False, family: str = "A") -> RewardFn:
    """C11: the reward builder for a configured name.

    Default registry: ``accuracy`` (C2 via C10) and ``format`` (C3). With a model-module
    override (``customised=True``) only task ``rec`` exists: ``accuracy`` → IoU (C5),
    ``format`` → C4 in the form of the model ``family`` (A: a box inside braces, B: a bare
    box). Anything else raises, as in the trainer.
    """
    if customised:
        if task == "rec" and name == "accuracy":
            return _iou
        if task == "rec" and name == "format":
            return _format_rec(braces=family == "A")
        raise ValueError(f"unsupported reward function: {name}")
    if name == "accuracy":
        return _accuracy(class_names)
    if name == "format":
        return _format
    raise KeyError(name)


def register_reward(fn: Callable, name: str, registry: dict[str, RewardFn]) -> None:
    """L1: plug a user reward in; ``fn`` is a pandas UDF ``(content, solution) -> double``."""
    def builder(content: Column | str, solution: Column | str, **_: Column) -> Column:
        return fn(_c(content), _c(solution))
    registry[name] = builder
