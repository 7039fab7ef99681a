"""Filter interaction audit: what every order of five document filters keeps and removes.

Each document becomes a mask of the filters it fails; documents are counted per (part, mask) –
at most 32 cells a part, by partial aggregation. A recursive query then extends prefixes of
filters by every unused letter. It walks the mask cells along and carries the bits applied so
far, so each recursion level says for each mask what that step does with it: at most
32 * 326 rows whatever the input. The counts of the parts join these by mask.

Defined results: a NULL text is empty, a NULL source is part ''. A row without doc_id neither
fails E nor makes others fail it, and has no labels. Rows that repeat a doc_id count each; with
the same text none of them is "smaller". Several labels of a doc_id count as their union. No
documents: no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Parts over which rows without doc_id are dealt for the join with labels.
NULL_PARTS = 64

WALK = """
with recursive letters as (
  select substr('ABCDE', i + 1, 1) as letter, shiftleft(1, i) as bit
  from explode(sequence(0, 4)) as t(i)),
walk(prefix, letter, mask, applied, step, kept, removed, redundant, alone) as (
  select '', '', mask, 0, 0, 1, 0, 0, 0 from {masks}
  union all
  select concat(w.prefix, l.letter), l.letter, w.mask, w.applied | l.bit, w.step + 1,
    cast(w.mask & (w.applied | l.bit) = 0 as int),
    cast(w.mask & w.applied = 0 and w.mask & l.bit != 0 as int),
    cast(w.mask & w.applied != 0 and w.mask & l.bit != 0 as int),
    cast(w.mask = l.bit as int)
  from walk w join letters l on w.applied & l.bit = 0)
select * from walk where step > 0
"""


def failures(words: Column, text: Column) -> dict[str, Column]:
    """The filters that need nothing but the text, by letter: whether it fails."""
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 50,
            "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 65,
            "C": upper.cast("long") * 100 > F.length(text).cast("long") * 5,
            "D": text.rlike("[#$%&*|]")}


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask``: per document the bits of the filters A to D it fails,
    and a digest that equal texts share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text")).withColumn(
        "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(fails, F.lit(1 << LETTERS.index(letter))).otherwise(0)
            for letter, fails in failures(F.col("words"), F.col("text")).items()]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                       reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and mask of all five filters.

    Rows are first counted per (doc_id, part, text). A text's smallest id comes from a partial
    aggregate and joins back on (digest, id), so copies of one text spread over all tasks.
    """
    same = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(
        "doc_id is not null").withColumn("is_first", F.lit(True))
    flags = labels.where("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn(
        "deal", F.lit(0).cast("long"))
    deal = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_PARTS)))
    dealt = same.join(first, ["digest", "doc_id"], "left").withColumn(
        "deal", F.coalesce(deal, F.lit(0).cast("long"))).join(flags, ["doc_id", "deal"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return dealt.groupBy("part", F.col("mask").bitwiseOR(
        F.when(copy, F.lit(16)).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def walk(masks: DataFrame) -> DataFrame:
    """Every prefix of unused letters with what its last step does to each mask."""
    return masks.sparkSession.sql(WALK, masks=masks)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    counted = stored(cells(stored(masked(docs), "audit-masks"), labels), "audit-cells")
    moves = stored(walk(counted.select("mask").distinct()), "audit-walk")
    total = lambda flag, of="n": F.sum(F.col(flag) * F.col(of)).cast("long")
    # at most 32 masks x 325 prefixes: a broadcast of proven size
    steps = stored(counted.join(F.broadcast(moves), "mask").groupBy(
        "part", "prefix", "letter", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"),
        total("redundant").alias("redundant"), total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"),
        total("removed", "toxic").alias("toxic_lost")), "audit-steps")
    orders = moves.where(F.col("step") == len(LETTERS)).select(
        F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("upto")).select(
        "filter_order", F.expr("substr(filter_order, 1, upto)").alias("prefix"))  # 600 rows
    # a prefix of k letters begins (5 - k)! orders
    shapley = steps.groupBy("part", "letter").agg(F.sum(
        F.col("removed") * F.factorial(F.lit(len(LETTERS)) - F.col("step"))).alias("shapley"))
    return steps.join(F.broadcast(orders), "prefix").join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
