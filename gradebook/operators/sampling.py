"""Seeded permutations, exact splits and group samplers.

The permutation key is ``md5(seed:id)`` – stable across engines and runs, unlike
``rand()``. Global positions come from :func:`gradebook.operators.ranking.positions`
with the first hex digits of the key as blocks, so the ordering is computed by many
tasks (md5 is uniform, blocks are balanced) and no task holds the whole table.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hex_block, positions


def permutation_key(id_col: str, seed: int | str) -> Column:
    """Hex md5 of ``'<seed>:<id>'``."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def shuffle(df: DataFrame, id_col: str, seed: int | str = 42, block_chars: int = 4,
            pos_col: str = "perm_pos") -> DataFrame:
    """Seeded full permutation; adds a 1-based ``perm_pos`` (ties broken by id)."""
    keyed = df.withColumn("_pkey", permutation_key(id_col, seed))
    out = positions(keyed, [], ["_pkey", id_col], hex_block("_pkey", block_chars), pos_col)
    return out.drop("_pkey")


def _with_total(df: DataFrame, total_col: str = "_n") -> DataFrame:
    """Attach the row count as a column (a one-row aggregate: broadcast-safe by design)."""
    n = df.agg(F.count(F.lit(1)).alias(total_col))
    return df.crossJoin(F.broadcast(n))


def exact_split(df: DataFrame, id_col: str, ratio: float = 0.1, seed: int | str = 42,
                rounding: str = "floor", split_col: str = "split") -> DataFrame:
    """Exactly ``int(n*ratio)`` (or ``ceil``) rows go to ``validation``, disjoint from
    ``train``. ``randomSplit`` is only approximate, hence the ranked cut.

    The permutation key is counted by its first four digits (at most 16**4 + 1 blocks). All
    rows of a block lie on one side of the cut, but for one block: only that one is ranked.
    """
    total = F.sum("_c").over(Window.partitionBy())
    cut = F.floor(total * F.lit(ratio)) if rounding == "floor" else F.ceil(total * F.lit(ratio))
    keyed = df.withColumn("_pkey", permutation_key(id_col, seed)).withColumn(
        "_blk", F.coalesce(hex_block("_pkey"), F.lit("")))
    counts = keyed.groupBy("_blk").agg(F.count(F.lit(1)).alias("_c"))
    bounds = counts.select("_blk", F.sum("_c").over(Window.orderBy("_blk")).alias("_to"),
                           "_c", cut.alias("_cut"))
    placed = keyed.join(F.broadcast(bounds), "_blk")  # at most 16**4 + 1 rows
    split = F.col("_to") > F.col("_cut")
    split = split & (F.col("_to") - F.col("_c") < F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy("_blk").orderBy("_pkey", id_col))
    whole = placed.where(~split).withColumn("_last", F.col("_to"))
    ranked = placed.where(split).withColumn("_last", F.col("_to") - F.col("_c") + rank)
    return whole.unionByName(ranked).select(
        *df.columns, F.when(F.col("_last") <= F.col("_cut"), F.lit("validation"))
        .otherwise(F.lit("train")).alias(split_col))


def group_sampler(df: DataFrame, id_col: str, mini_repeat: int, batch_size: int = 1,
                  repeat: int = 1, seed: int | str = 42) -> DataFrame:
    """Permute; cut into chunks of ``batch_size`` and drop a short last chunk; emit each
    chunk ``repeat`` times and every index ``mini_repeat`` times in a row.

    Output: ``(sample_pos, <id>)`` with ``sample_pos`` the 0-based position in the stream.
    """
    ranked = _with_total(shuffle(df, id_col, seed))
    p = F.col("perm_pos") - 1
    full_chunks = F.floor(F.col("_n") / F.lit(batch_size))
    kept = ranked.filter(F.floor(p / F.lit(batch_size)) < full_chunks)
    per_chunk = batch_size * repeat * mini_repeat
    k = F.explode(F.sequence(F.lit(0), F.lit(repeat * mini_repeat - 1))).alias("_k")
    exploded = kept.select("*", k)
    r = F.floor(F.col("_k") / F.lit(mini_repeat))
    m = F.col("_k") % F.lit(mini_repeat)
    chunk = F.floor(p / F.lit(batch_size))
    inner = p % F.lit(batch_size)
    pos = (chunk * F.lit(per_chunk) + r * F.lit(batch_size * mini_repeat)
           + inner * F.lit(mini_repeat) + m).cast("long")
    return exploded.select(pos.alias("sample_pos"), F.col(id_col))


def repeat_sampler(df: DataFrame, id_col: str, repeats: int,
                   seed: int | str = 42) -> DataFrame:
    """Permute and repeat each index ``repeats`` times in a row; nothing dropped."""
    ranked = shuffle(df, id_col, seed)
    k = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_k")
    out = ranked.select("*", k)
    pos = ((F.col("perm_pos") - 1) * F.lit(repeats) + F.col("_k")).cast("long")
    return out.select(pos.alias("sample_pos"), F.col(id_col))


def sampler_length(n: int, mini_repeat: int, repeat: int = 1) -> int:
    """The length the group sampler *reports* (it ignores the dropped chunk)."""
    return n * mini_repeat * repeat


def check_group_sizes(df: DataFrame, group_col: str, size: int) -> DataFrame:
    """Groups whose row count is not exactly ``size`` (empty when all are complete)."""
    if size < 2:
        raise ValueError("group size must be at least 2")
    return (df.groupBy(group_col).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") != F.lit(size)))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """H4: distinct values, sorted."""
    return df.select(col).distinct().orderBy(col)

