"""Mixing sources to target weights with hash-random order and distributed prefix sums.

Per source the documents are ordered by a hash of (seed, id); the mix takes whole epochs
and, of the last one, the documents up to the exact word budget. The order is cut into hash
ranges (blocks) whose number follows the row count, so about ``ROWS_PER_BLOCK`` rows of one
source share a block however large the source is. Block sums give the block that holds the
cut; only that block is ordered, every other row is decided by its block alone.

Words of a text: maximal runs without space and 0x09-0x0D (``size``; NULL text: 0).
Targets: sources by code point, NULL last, weigh 3, 1, 2, repeating, and share
``SHARE`` of all words; a target stops at ``MAX_EPOCHS`` times its source's words and the
excess goes to the others by weight. The fixed point is ``min(cap, level * weight)``; the
level is found in closed form over the sources in order of cap/weight.

Defined cases: an empty table gives no rows; a source without words gets target 0; NULL ids
and sources are values like others; equal (id, size) rows at the cut share the words left
evenly, rounded down; extra columns pass through :func:`mix` unless they carry a result
name, which is then replaced.

Bound: the table of sources (one row each, pre-aggregated) is ordered in one task to give
the weights. It is joined by its stored size: broadcast below the threshold only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, stored

# Fixed values of the mix.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
ROWS_PER_BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` of a table (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.lit(WEIGHTS[-1])
    for i, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(at == i, F.lit(w)).otherwise(weight)
    ranked = per_source.withColumn("weight", weight).withColumn(
        "cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.withColumn("level", (
        F.sum("source_size").over(everything) * SHARE
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"),
                              F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return level.withColumn("open", open_level["level"]).select(
        "source", "source_size", "weight",
        F.coalesce(F.least("cap", F.col("open") * F.col("weight")), F.col("cap")).alias("target"))


def plan(sized: DataFrame) -> DataFrame:
    """Per source the cut of its last epoch: ``epochs`` full passes, then all rows before
    ``cut`` (key, id, size) and ``cut_words`` words of each row equal to it."""
    source_targets = stored(targets(sized), "mix-targets").withColumn(
        "budget", F.round("target").cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.least(
            F.lit(MAX_EPOCHS), F.floor(F.col("budget") / F.col("source_size")))).otherwise(0)
        .cast("long")).withColumn(
        "rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    rows = sized.agg(F.count(F.lit(1)).alias("rows"))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    blocked = sized.crossJoin(F.broadcast(rows)).withColumn(
        "block", F.floor(spread * F.ceil(F.col("rows") / ROWS_PER_BLOCK)))
    sums = blocked.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets_ = source_targets.withColumnRenamed("source", "of")
    holds = sums.join(targets_, F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))
    ).select("of", F.col("block").alias("cut_block"), "ahead", "rest")
    inside = blocked.join(holds, F.col("source").eqNullSafe(F.col("of"))
                          & (F.col("block") == F.col("cut_block")))
    groups = inside.groupBy("of", "key", "doc_id", "size").agg(
        F.count(F.lit(1)).alias("copies"), F.first("ahead").alias("ahead"),
        F.first("rest").alias("rest"))
    order = Window.partitionBy("of").orderBy("key", "doc_id", "size")
    total = F.col("size") * F.col("copies")
    groups = groups.withColumn("upto", F.col("ahead") + F.sum(total).over(order))
    cut = groups.where((F.col("upto") > F.col("rest")) & (F.col("upto") - total <= F.col("rest"))
                       ).select(F.col("of").alias("cut_of"),
                                F.struct("key", "doc_id", "size").alias("cut"),
                                F.floor((F.col("rest") - F.col("upto") + total)
                                        / F.col("copies")).alias("cut_words"))
    return source_targets.join(cut, F.col("source").eqNullSafe(F.col("cut_of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "cut", "cut_words")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (words the mix takes of the row);
    other columns of any name stay."""
    kept = docs.drop(*[c for c in RESULTS if c in docs.columns])
    sized = stored(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    own = free_name(docs, "_plan")  # all helper columns below one free name
    cuts = stored(plan(sized), "mix-plan")
    cuts = cuts.select(F.struct(*cuts.columns).alias(own))
    cut = lambda c: F.col(f"{own}.{c}")
    me = F.struct(random_key(F.col("doc_id"), seed).alias("key"), F.col("doc_id"),
                  F.col("size"))
    extra = (F.when(me < cut("cut"), F.col("size"))
             .when(me == cut("cut"), cut("cut_words")).otherwise(F.lit(0)))
    out = kept.withColumn("size", word_count(F.col("text"))).join(
        cuts, F.col("source").eqNullSafe(cut("of")), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns], "size", cut("source_size").alias("source_size"),
        cut("target").alias("target"),
        (cut("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` from the stored sizes (one text scan)."""
    sized = stored(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    cuts = stored(plan(sized), "mix-plan")
    me = F.struct("key", "doc_id", "size")
    extra = (F.when(me < F.col("cut"), F.col("size"))
             .when(me == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0)))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))
