"""Group-relative reward statistics and token-level diagnostics.

Rewards, group means and standard deviations are ``groupBy`` aggregations (partial on
the map side, so a prompt group with millions of completions is pre-aggregated before
the shuffle); the group statistics are then joined back on the group key, which AQE's
skew-join handling splits if one group is huge. Token diagnostics aggregate per
completion row first, then over rows – the two-level mean of the trainer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewards import RewardFn

ADVANTAGE_EPS = 1e-4


def score(rollouts: DataFrame, examples: DataFrame, key: str,
          rewards: Mapping[str, RewardFn], content: str = "content",
          solution: str = "solution") -> DataFrame:
    """D9 + C10: join each completion to its own prompt's columns and add one column per
    reward function (``reward_<name>``). Joined on the prompt key, not by position."""
    joined = rollouts.join(examples, on=key, how="inner")
    cols = [fn(F.col(content), F.col(solution)).alias(f"reward_{name}")
            for name, fn in rewards.items()]
    return joined.select("*", *cols)


def total_reward(df: DataFrame, reward_cols: Sequence[str], out: str = "reward") -> DataFrame:
    """Plain sum over the reward functions (weights are not applied, as in the trainer)."""
    total = F.lit(0.0)
    for c in reward_cols:
        total = total + F.col(c)
    return df.withColumn(out, total)


def group_stats(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Per group mean and **sample** standard deviation (NULL for a one-row group)."""
    return df.groupBy(group).agg(
        F.avg(reward).alias("group_mean"),
        F.stddev_samp(reward).alias("group_std"),
        F.count(F.lit(1)).alias("group_size"))


def advantages(df: DataFrame, group: str, reward: str = "reward",
               eps: float = ADVANTAGE_EPS) -> DataFrame:
    """``(reward - group mean) / (group std + eps)`` with the stats joined back."""
    stats = group_stats(df, group, reward)
    out = df.join(stats, on=group, how="inner")
    return out.withColumn(
        "advantage", (F.col(reward) - F.col("group_mean")) / (F.col("group_std") + F.lit(eps)))


def batch_metrics(df: DataFrame, step: str, reward_cols: Sequence[str], length: Column,
                  reward: str = "reward", std: str = "group_std") -> DataFrame:
    """Per step – mean completion length, mean of each reward function, mean reward
    and mean group std (row weighted, as the std is repeated per row). Long form
    ``(step, name, value)``."""
    aggs = [F.avg(length).alias("completion_length")]
    aggs += [F.avg(c).alias(f"rewards/{c.removeprefix('reward_')}") for c in reward_cols]
    aggs += [F.avg(reward).alias("reward"), F.avg(std).alias("reward_std")]
    wide = df.groupBy(step).agg(*aggs)
    names = ["completion_length", *[f"rewards/{c.removeprefix('reward_')}" for c in reward_cols],
             "reward", "reward_std"]
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value"))
                                for n in names])).alias("m")
    return wide.select(step, stack).select(step, "m.name", "m.value")


def flush_metrics(metrics: DataFrame, step: str, logging_steps: int,
                  prefix: str = "") -> DataFrame:
    """Unweighted mean of the buffered values per name over each logging window of
    ``logging_steps`` steps (window ``k`` holds steps ``k*L .. k*L+L-1``)."""
    window = F.floor(F.col(step) / F.lit(logging_steps)).cast("long")
    name = F.concat(F.lit(prefix), F.col("name")) if prefix else F.col("name")
    return (metrics.groupBy(window.alias("log_window"), name.alias("name"))
            .agg(F.avg("value").alias("value")))


# ---- token-level diagnostics over a long table (row_id, pos, token, lp, old_lp, ref_lp) ----

def completion_mask(tokens: DataFrame, row: str, pos: str, token: str, eos: int) -> DataFrame:
    """mask 1 up to and including the first EOS of each row, all ones if none."""
    first = (tokens.filter(F.col(token) == F.lit(eos)).groupBy(row)
             .agg(F.min(pos).alias("_first_eos")))
    out = tokens.join(first, on=row, how="left")
    return out.withColumn(
        "mask", F.when(F.col("_first_eos").isNull() | (F.col(pos) <= F.col("_first_eos")),
                       F.lit(1)).otherwise(F.lit(0))).drop("_first_eos")


def mask_array(ids: Column, eos: int) -> Column:
    """F7 (array form): 1s up to and including the first EOS, then 0s."""
    p = F.array_position(ids, F.lit(eos))
    n = F.size(ids)
    keep = F.when(p > 0, p).otherwise(n)
    return F.transform(ids, lambda _, i: F.when(i < keep, F.lit(1)).otherwise(F.lit(0)))


def next_token_alignment(tokens: DataFrame, row: str, pos: str, token: str) -> DataFrame:
    """F8: the score at position i belongs to token i+1 (``lead`` within a sequence).
    A sequence is bounded by the model's context length, so the window is bounded."""
    w = Window.partitionBy(row).orderBy(pos)
    return tokens.withColumn("target_token", F.lead(token).over(w))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """F8: ``logit[index] - logsumexp(logits)``, shifted by the max for stability."""
    mx = F.array_max(logits)
    lse = mx + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
    return F.element_at(logits, index + 1) - lse


def token_loss_terms(tokens: DataFrame, lp: str = "lp", old_lp: str = "old_lp",
                     ref_lp: str = "ref_lp", adv: str = "advantage",
                     eps_low: float = 0.2, eps_high: float | None = None,
                     beta: float = 0.04) -> DataFrame:
    """E5/E6 per token: KL ``exp(d)-d-1`` (d = ref - lp), ratio, clipped ratio, loss and
    the clipped flag (``r*A < clip(r)*A``)."""
    eps_high = eps_low if eps_high is None else eps_high
    d = F.col(ref_lp) - F.col(lp)
    kl = F.exp(d) - d - F.lit(1.0)
    ratio = F.exp(F.col(lp) - F.col(old_lp))
    clipped = F.least(F.greatest(ratio, F.lit(1.0 - eps_low)), F.lit(1.0 + eps_high))
    l1, l2 = ratio * F.col(adv), clipped * F.col(adv)
    loss = -F.least(l1, l2)
    if beta > 0:
        loss = loss + F.lit(beta) * kl
    return tokens.select("*", kl.alias("kl"), loss.alias("token_loss"),
                         (l1 < l2).cast("int").alias("is_clipped"))


def row_means(terms: DataFrame, row: str, mask: str = "mask") -> DataFrame:
    """Masked mean per completion row of KL and loss (first level of the two-level mean)."""
    m = F.col(mask)
    return terms.groupBy(row).agg(
        F.sum(m).alias("mask_len"),
        F.count(F.lit(1)).alias("n_tokens"),
        (F.sum(F.col("kl") * m) / F.sum(m)).alias("row_kl"),
        (F.sum(F.col("token_loss") * m) / F.sum(m)).alias("row_loss"),
        F.sum(F.col("is_clipped") * m).alias("clipped_tokens"))


def loss_summary(rows: DataFrame) -> DataFrame:
    """E5/E6 second level: mean over rows; clip ratio = Σ clipped / Σ mask (all tokens)."""
    return rows.agg(
        F.avg("row_kl").alias("kl"),
        F.avg("row_loss").alias("loss"),
        (F.sum("clipped_tokens") / F.sum("mask_len")).alias("clip_ratio"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("mask_len").alias("n_masked_tokens"))


def pad_sequences(df: DataFrame, ids: str, batch: str, pad: int, side: str = "right",
                  out: str | None = None) -> DataFrame:
    """Pad the id arrays of each batch to the batch's longest (prompts on the
    left, completions on the right). A batch is bounded by the trainer's batch size."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_len"))
    filler = F.array_repeat(F.lit(pad), F.col("_len") - F.size(ids))
    padded = F.concat(filler, F.col(ids)) if side == "left" else F.concat(F.col(ids), filler)
    return (df.join(longest, on=batch, how="inner")
            .withColumn(out or ids, padded).drop("_len"))


def clip_rows(df: DataFrame, order: str, max_samples: int | None = None,
              tokens: str | None = None, cutoff_len: int | None = None) -> DataFrame:
    """At most ``max_samples`` rows (the first in ``order`` – the cap is the
    feature) and token arrays cut to ``cutoff_len``."""
    out = df
    if tokens and cutoff_len:
        out = out.withColumn(tokens, F.slice(F.col(tokens), 1, cutoff_len))
    if max_samples is not None:
        out = out.orderBy(order).limit(max_samples)
    return out
