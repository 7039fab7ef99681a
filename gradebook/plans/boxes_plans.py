"""Box rewards and image-size planning (survey build step 10).

``lineitem`` rows become grounding answers: an integer ground-truth box derived from the
line's numbers, a predicted box shifted from it, and completion texts whose format
depends on the return flag (no answer block / bare list / JSON object). Rewards: IoU
(C5 with C6) and the two format rules (C4). ``part`` sizes become image sizes for the
tile planner (B23) and the minimum-size rule (B24).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rewards import with_iou_reward
from ..functions.text import format_reward_rec
from ..functions.prompts import expand_image_tokens
from ..functions.vision import min_size, plan_tiles
from ..session import table


def _int(c) -> F.Column:
    return F.round(c, 0).cast("int")


def box_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_returnflag")
    x1 = F.col("l_linenumber") * 10
    y1 = _int(F.col("l_quantity"))
    x2 = x1 + 20 + _int(F.col("l_tax") * 100)
    y2 = y1 + 10 + _int(F.col("l_discount") * 100)
    px1 = x1 + _int(F.col("l_discount") * 100)
    py1 = y1 + F.col("l_linenumber")
    px2, py2 = x2 + 3, y2 - 1
    gt = F.format_string("[%d, %d, %d, %d]", x1, y1, x2, y2)
    pred = F.format_string("[%d, %d, %d, %d]", px1, py1, px2, py2)
    content = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<think>no box</think> "), pred))
               .when(F.col("l_returnflag") == "A",
                     F.concat(F.lit("<think>found it</think>\n<answer>"), pred,
                              F.lit("</answer>")))
               .otherwise(F.concat(F.lit("<think>found it</think><answer>{\"bbox_2d\": "), pred,
                                   F.lit("}</answer>"))))
    solution = F.concat(F.lit("<answer>"), gt, F.lit("</answer>"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag",
                     content.alias("content"), solution.alias("solution"))


def box_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 10 (C4 C5 C6): IoU reward and both format rewards per line."""
    a = with_iou_reward(box_answers(spark, sf_dir), "content", "solution", "_iou")
    return a.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.round("_iou", 9).alias("iou_reward"),
        format_reward_rec("content", braces=True).alias("format_reward_a"),
        format_reward_rec("content", braces=False).alias("format_reward_b"))


def tile_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 10 (B23 B24): tile grid per part image and its minimum-size adjustment."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sized = p.select("p_partkey", (F.col("p_size") * 40).alias("width"),
                     ((F.lit(51) - F.col("p_size")) * 3).alias("height"))
    plan = plan_tiles("width", "height")
    fixed = min_size("width", "height")
    return sized.select(
        "p_partkey", "width", "height",
        plan["cols"].alias("cols"), plan["rows"].alias("rows"), plan["blocks"].alias("blocks"),
        F.when(plan["blocks"] > 1, plan["blocks"] + 1).otherwise(plan["blocks"]).alias("tiles"),
        fixed["width"].alias("min_width"), fixed["height"].alias("min_height"))


TOKENS_PER_PATCH = 4


def image_token_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B22 on top of B23: each part image's prompt gets its ``<image>`` placeholder
    expanded to start + context tokens × (tokens per patch × tiles) + end, the tile
    count coming from the tile planner."""
    plans = tile_plans(spark, sf_dir).select("p_partkey", "tiles")
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    prompt = F.concat(F.lit("<image>\nDescribe "), F.col("p_name"))
    expanded = expand_image_tokens(prompt, F.array(F.col("tiles")), TOKENS_PER_PATCH)
    return plans.join(names, on="p_partkey").select(
        "p_partkey", "tiles", F.length(expanded).alias("query_chars"),
        F.md5(expanded).alias("query_md5"))
