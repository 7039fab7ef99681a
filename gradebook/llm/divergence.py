"""Source divergence audit over run-length columns.

Per language, the terms that at least ``LEAST_DOCS`` of its documents hold are the vocabulary;
each source's smoothed share of a term is an exact integer. Shares are compared between all
sources of a language without a term x source x source table:

* a term is the sparse vector of its counts by source. Terms with equal vectors collapse into
  one row with a multiplicity, and the vocabulary is reordered by (range of total count,
  vector), which puts equal counts of a source next to each other;
* the order is cut into blocks of about ``BLOCK_TERMS`` different vectors and the sources into
  tiles of ``TILE``; a (block, tile) is run-length encoded by column in one task;
* tiles of a block meet in pairs. A pair of columns intersects its run boundaries, and each
  stretch adds f = |p - q| times its length. Block sums are then added up.

Defined results: NULL text, lang and source are ''. Every (lang, source) that occurs is a group,
also one without terms; without vocabulary all pairs have value 0 and there are no terms. Ties
rank by item in UTF-8 order. No documents: no rows. Extra columns are not read. Repeated rows
count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
TILE = 32
BLOCK_TERMS = 4096
#: Distinct (group, term) counts a counting task holds before it passes them on.
HELD_TERMS = 1 << 18

TALLY = "lang string, source string, term string, tf long, df long"
COLUMNS = ("lang string, block string, tile int, size long, numbers array<int>, "
           "starts array<array<long>>, shares array<array<long>>")
SUMS = "lang string, a int, b int, value long"

#: Bytes that belong to a term, A-Z as a-z; all others are separators.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def tallies(docs: DataFrame) -> DataFrame:
    """``lang, source, term, tf, df`` summed per task in bounded parts; a NULL term marks the
    group itself."""
    def strings(words: list[bytes | None]) -> pa.Array:
        try:
            return pa.array(words, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # a text that is no valid UTF-8
            return pa.array([w if w is None else w.decode("utf-8", "replace") for w in words])

    def packed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        columns: list[list[pa.Array]] = [[], [], [], [], []]
        for (of_lang, of_source), (words, holders) in held.items():
            n = len(words) + 1
            tf, df = np.zeros(n, np.int64), np.zeros(n, np.int64)
            tf[1:] = np.fromiter(words.values(), np.int64, n - 1)
            df[1:] = np.fromiter(map(holders.__getitem__, words), np.int64, n - 1)
            for column, part in zip(columns, (
                    pa.repeat(pa.scalar(of_lang, pa.string()), n),
                    pa.repeat(pa.scalar(of_source, pa.string()), n),
                    strings([None, *words]), pa.array(tf), pa.array(df))):
                column.append(part)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns],
                                          names=["lang", "source", "term", "tf", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(batch.column(0).to_pylist(),
                                          batch.column(1).to_pylist(), texts):
                words, holders = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(words)
                own = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                words.update(own)
                holders.update(set(own))
                size += len(words) - before
                if size >= HELD_TERMS:
                    yield packed(held)
                    held, size = {}, 0
        if held:
            yield packed(held)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")]).mapInArrow(run, TALLY)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * whole(count + PRIOR)
    return F.call_function("div", over, whole(total + terms * PRIOR)) + 1


def _share_of(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``share`` of counts in a task (in Python integers where 64 bits do not hold them)."""
    if len(count) and int(count.max()) + PRIOR > (1 << 63) // SCALE:
        return np.array([1 + SCALE * (int(c) + PRIOR) // (total + PRIOR * terms) for c in count])
    return 1 + SCALE * (count + PRIOR) // (total + PRIOR * terms)


def groups_of(counts: DataFrame, kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, no, n, terms, lang_n``: the groups, numbered within their language, with
    the sum of their counts, the vocabulary size and the language's sum."""
    sums = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return counts.where("term is null").select("lang", "source").distinct().withColumn(
        "no", number).join(sums, ["lang", "source"], "left").join(
        totals, "lang", "left").select(
        "lang", "source", "no", *[F.coalesce(c, F.lit(0)).alias(c)
                                  for c in ("n", "terms", "lang_n")])


def ordered_vectors(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, block, start, m, vector``: the different count vectors of a language with
    their multiplicity and place in the block's order."""
    entry = F.struct("no", "tf")
    per_term = kept.join(groups.select("lang", "source", "no"), ["lang", "source"]).groupBy(
        "lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("vector"),
                            F.sum("tf").alias("total"))
    rows = stored(per_term.groupBy("lang", "vector").agg(
        F.count(F.lit(1)).alias("m"), F.min("total").alias("total")).withColumn(
        "range", F.floor(F.log2("total") * 2).cast("int")), "divergence-vectors")
    cuts = rows.groupBy("lang", "range").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).cast("long").alias("cuts"))
    part = F.pmod(F.xxhash64("vector"), F.col("cuts"))
    before = Window.partitionBy("lang", "block").orderBy("total", "vector").rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.join(cuts, ["lang", "range"]).withColumn(
        "block", F.concat_ws(".", "range", part)).select(
        "lang", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), "m",
        "vector")


def columns(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """The run-length columns of each (language, block, tile of sources)."""
    tile = F.floor(F.col("no") / TILE).cast("int")
    sources = groups.groupBy("lang", tile.alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct("no", "n"))).alias("sources"),
        F.max("terms").alias("terms"))
    blocks = vectors.groupBy("lang", "block").agg(F.sum("m").alias("size")).unionByName(
        groups.select("lang", F.lit("").alias("block"), F.lit(0).cast("long").alias("size"))
        .distinct())  # an empty block: every pair of sources has a row
    entries = vectors.select("lang", "block", "start", "m", F.explode("vector").alias("e")).select(
        "lang", "block", F.floor(F.col("e.no") / TILE).cast("int").alias("tile"),
        F.struct("e.no", "start", "m", "e.tf").alias("e"))
    filled = entries.groupBy("lang", "block", "tile").agg(F.collect_list("e").alias("entries"))
    rows = blocks.join(sources, "lang").join(filled, ["lang", "block", "tile"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"numbers": [], "starts": [], "shares": []}
            for row in batch.select(["size", "terms", "sources", "entries"]).to_pylist():
                encoded = encode(row["entries"] or [], row["sources"], row["size"], row["terms"])
                for name, values in zip(out, encoded):
                    out[name].append(values)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("lang", "block", "tile", "size")),
                 pa.array(out["numbers"], pa.list_(pa.int32())),
                 pa.array(out["starts"], pa.list_(pa.list_(pa.int64()))),
                 pa.array(out["shares"], pa.list_(pa.list_(pa.int64())))],
                names=["lang", "block", "tile", "size", *out])
    return rows.mapInArrow(run, COLUMNS)


def encode(entries: list[dict], sources: list[dict], size: int, terms: int):
    """Run-length columns of the sources of a tile over a block of ``size`` terms: per source
    the starts of its runs and the share of each run. ``entries``: (source number, start,
    length, count) stretches of counts above 0."""
    table = np.array([[e["no"], e["start"], e["m"], e["tf"]] for e in entries],
                     np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    numbers, starts, shares = [], [], []
    for source in sources:
        a, b = np.searchsorted(table[:, 0], [source["no"], source["no"] + 1])
        _, at, length, count = table[a:b].T
        # every stretch opens a run, and what follows it opens one of zeros unless it is next
        edges = np.concatenate([[0], at, at + length])
        values = np.concatenate([[0], count, np.zeros(len(at), np.int64)])
        kind = np.concatenate([[0], np.full(len(at), 2), np.full(len(at), 1)])
        order = np.lexsort((kind, edges))
        edges, values = edges[order], values[order]
        last = np.append(edges[1:] != edges[:-1], True) & ((edges < size) | (edges == 0))
        edges, values = edges[last], values[last]
        new = np.append(True, values[1:] != values[:-1])
        numbers.append(source["no"])
        starts.append(edges[new])
        shares.append(_share_of(values[new], source["n"], terms) if terms else values[new])
    return numbers, starts, shares


def distance(starts: np.ndarray, shares: np.ndarray, other_starts: np.ndarray,
             other_shares: np.ndarray, size: int) -> int:
    """Sum of |p - q| over a block: run boundaries intersected, f times the run length."""
    edges = np.union1d(starts, other_starts)
    p = shares[np.searchsorted(starts, edges, "right") - 1]
    q = other_shares[np.searchsorted(other_starts, edges, "right") - 1]
    return int((np.abs(p - q) * np.diff(np.append(edges, size))).sum())


def pair_values(tiles: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of every pair of sources (numbers a < b) of a language."""
    left = tiles.select("lang", "block", "size", F.col("tile").alias("t1"), *[
        F.col(c).alias(f"{c}_1") for c in ("numbers", "starts", "shares")])
    right = tiles.select("lang", "block", F.col("tile").alias("t2"), *[
        F.col(c).alias(f"{c}_2") for c in ("numbers", "starts", "shares")])
    met = left.join(right, ["lang", "block"]).where("t1 <= t2")

    def side(row: dict, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(n, np.array(s, np.int64), np.array(p, np.int64)) for n, s, p in zip(
            row[f"numbers_{k}"], row[f"starts_{k}"], row[f"shares_{k}"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = [(a, b, distance(s, p, t, q, row["size"]))
                         for a, s, p in side(row, 1) for b, t, q in side(row, 2) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]] * len(found), pa.string()),
                     *(pa.array([f[k] for f in found], t) for k, t in enumerate(
                         (pa.int32(), pa.int32(), pa.int64())))],
                    names=["lang", "a", "b", "value"])
    return met.mapInArrow(run, SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of the divergence audit."""
    counts = stored(tallies(docs).groupBy("lang", "source", "term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df")), "divergence-counts")
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("tf").alias("lang_tf"), F.sum("df").alias("df")).where(
        F.col("df") >= LEAST_DOCS).drop("df")
    kept = stored(counts.where("term is not null").drop("df").join(
        vocabulary, ["lang", "term"]), "divergence-kept")
    totals = kept.groupBy("lang", "term").agg(F.max("lang_tf").alias("lang_tf")).groupBy(
        "lang").agg(F.sum("lang_tf").alias("lang_n"), F.count(F.lit(1)).alias("terms"))
    groups = stored(groups_of(counts, kept, totals), "divergence-groups")

    tiles = stored(columns(ordered_vectors(kept, groups), groups), "divergence-columns")
    sums = pair_values(tiles)
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"),
                                        "value"))
    names = groups.select("lang", "no", "source")
    pairs = both.join(names.withColumnRenamed("no", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")),
        ["lang", "b"])

    p = share(F.col("tf"), F.col("n"), F.col("terms"))
    q = share(F.col("lang_tf"), F.col("lang_n"), F.col("terms"))
    over = kept.join(groups.drop("no"), ["lang", "source"]).withColumn(
        "value", p - q).where("value > 0")
    parts = [(pairs, "pair", _ranked), (over.withColumnRenamed("term", "item"), "term",
             lambda rows: _ranked(rows).where(F.col("rank") <= TOP_TERMS))]
    found = [rank(rows.select("lang", "source", F.lit(name).alias("part"), "item",
                              F.col("value").cast("long").alias("value")))
             for rows, name, rank in parts]
    return found[0].unionByName(found[1])
