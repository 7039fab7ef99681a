"""Group-relative training-step plans (survey build steps 9 and 12).

Step 9 – ``conversations`` as rollouts: a conversation is one prompt group (prompt_id =
conv_id); its assistant turns are the completions; the solution is the language marker
(C1) of the conversation's first user turn. Rewards are the trainer's default registry
(accuracy = C2, format = C3), summed (E2), normalised per group (E3, F6) and logged per
step (E4, E7).

Step 12 – ``events`` as token streams: one user = one completion row, the user's events
in event_id order are its tokens, an ``error`` event is the EOS token; log-probabilities
are derived from ``value``. Masks (F7), KL (E5), loss and clip ratio (E6) follow the
trainer's formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rewards import select_reward
from ..functions.text import first_mentioned_class
from ..operators import grpo
from ..session import table
from .evaluation_plans import CLASS_NAMES

PROMPTS_PER_STEP = 4
LOGGING_STEPS = 5
REWARDS = ("accuracy", "format")
ROUND = 6


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first_user = (conv.filter(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("problem")))
    return first_user.select(
        "conv_id", first_mentioned_class("problem", CLASS_NAMES).alias("solution"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conv.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("gen_idx"), F.col("text").alias("content"))


def scored_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = {n: select_reward(n, class_names=CLASS_NAMES) for n in REWARDS}
    scored = grpo.score(rollouts(spark, sf_dir), examples(spark, sf_dir), "conv_id", fns)
    scored = grpo.total_reward(scored, [f"reward_{n}" for n in REWARDS])
    return grpo.advantages(scored, "conv_id")


def rollout_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 9 (D9 C10 C2 C3 E2 E3 F6): per completion rewards and advantage."""
    s = scored_rollouts(spark, sf_dir)
    return s.select(
        "conv_id", "gen_idx", "solution", "reward_accuracy", "reward_format", "reward",
        F.round("group_mean", ROUND).alias("group_mean"),
        F.round("group_std", ROUND).alias("group_std"),
        F.round("advantage", ROUND).alias("advantage"))


def _step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_rollouts(spark, sf_dir).withColumn(
        "step", F.floor(F.col("conv_id") / F.lit(PROMPTS_PER_STEP)).cast("long"))
    length = F.size(F.split(F.col("content"), " ")).cast("double")
    return grpo.batch_metrics(s, "step", [f"reward_{n}" for n in REWARDS], length)


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 9 (E4): per-step logged metrics in long form."""
    m = _step_metrics(spark, sf_dir)
    return m.select("step", "name", F.round("value", ROUND).alias("value"))


def logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 9 (E7): metrics averaged over windows of 5 steps."""
    m = grpo.flush_metrics(_step_metrics(spark, sf_dir), "step", LOGGING_STEPS)
    return m.select("log_window", "name", F.round("value", ROUND).alias("value"))


# ---- step 12: token diagnostics ----

EOS_TYPE = "error"
# Fixed values of this plan: token ids of the event types (EOS = error).
TOKEN_IDS = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 0}
EOS_ID = TOKEN_IDS[EOS_TYPE]


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    tok = F.create_map(*[F.lit(x) for kv in TOKEN_IDS.items() for x in kv])
    adv = ev.groupBy("user_id").agg(
        ((F.avg("value") - F.lit(50.0)) / F.lit(50.0)).alias("advantage"))
    return ev.join(adv, on="user_id", how="inner").select(
        F.col("user_id").alias("row_id"), F.col("event_id").alias("pos"),  # only its order counts
        F.coalesce(F.element_at(tok, F.col("event_type")), F.lit(-1)).alias("token"),
        (-F.col("value") / F.lit(100.0)).alias("lp"),
        (-F.col("value") / F.lit(90.0)).alias("old_lp"),
        (-F.col("value") / F.lit(110.0)).alias("ref_lp"),
        "advantage")


def token_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 12 (F7 E5 E6, first level): per row mask length, KL, loss, clipped tokens."""
    t = grpo.completion_mask(token_table(spark, sf_dir), "row_id", "pos", "token", EOS_ID)
    rows = grpo.row_means(grpo.token_loss_terms(t), "row_id")
    return rows.select("row_id", "n_tokens", "mask_len", "clipped_tokens",
                       F.round("row_kl", 9).alias("row_kl"),
                       F.round("row_loss", 9).alias("row_loss"))


def token_loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 12 (E5 E6, second level): KL, loss and clip ratio over all rows."""
    t = grpo.completion_mask(token_table(spark, sf_dir), "row_id", "pos", "token", EOS_ID)
    s = grpo.loss_summary(grpo.row_means(grpo.token_loss_terms(t), "row_id"))
    return s.select(F.round("kl", 9).alias("kl"), F.round("loss", 9).alias("loss"),
                    F.round("clip_ratio", 9).alias("clip_ratio"), "n_rows", "n_masked_tokens")
