"""SimHash near-duplicates by one-wildcard segment variants.

Of two 64-bit fingerprints with at most three differing bits, one of their two 32-bit segments
differs in at most one bit. Each distinct fingerprint is indexed under the 64 variants (segment,
bit left out, other 31 bits): two such fingerprints agree in at least one. Rows of a variant
meet by equality of its key, are verified by popcount, and leave as links of a spanning forest
of the variant's rows. A variant of more than ``LIMIT`` fingerprints is not compared: its rows
are indexed again under one-wildcard variants of the two halves of the other segment, and once
more of the halves of what is left. Then at most 11 bits are free, so no group is ever larger
than ``LIMIT`` and no link is lost.

Defined results: a NULL text is empty, its fingerprint zero; rows without doc_id get a
fingerprint and their component's smallest id (NULL if it has none); repeated ids and rows each
give a row; no documents: no rows; extra columns are not read. A text of any length is read in
pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

SHINGLE = 3
SEED = 42
PIECE = 1 << 20
DISTANCE = 3
LIMIT = 2048
#: A key with more than this share of all rows is one of fewer than its inverse many.
HOT_SHARE = 1000
PRINT = "doc_id long, fp long"
FOUND = "a long, b long, path int"
VARIANT = "path int, fixed long, fp long"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(body: bytes) -> Iterator[list[bytes]]:
    """The words of ``body`` in runs of about ``PIECE`` bytes."""
    at = 0
    while at < len(body):
        gap = _SPACE.search(body, at + PIECE)
        end = gap.start() if gap else len(body)
        yield body[at:end].split()
        at = end


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each run of ``SHINGLE`` words (fewer words: of all of them)."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:max(1, len(words) - SHINGLE + 1)]
    ends = ends[min(SHINGLE, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())],
                    np.uint64)


def fingerprint(text: bytes) -> int:
    """The text's fingerprint, as a signed 64-bit number."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for more in _pieces(text.lower()):
        words = words[-(SHINGLE - 1):] + more if total else words + more
        if len(words) >= SHINGLE:
            found = _hashes(words)
            ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(0, dtype=np.int64)
            total += len(found)
    if not total and words:
        return int(_hashes(words).view(np.int64)[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0
                      for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PRINT)


# ------------------------------------------------------------------ one-wildcard variants

def _halves(low: int, size: int) -> tuple[tuple[int, int], tuple[int, int]]:
    return (low, size // 2), (low + size // 2, size // 2)


def _left_out(low: int, size: int, bit: int) -> int:
    """The bits of a segment without one of them."""
    return ((1 << size) - 1 << low) & ~(1 << bit)


def _children(level: int) -> list[list[tuple[int, tuple[int, int]]]]:
    """Per path of ``level`` the (fixed bits, segment that is left) of each of its variants.

    A level cuts the segment that is left (at first all 64 bits) in two and leaves out one
    bit of either half; a variant's place in this order is its path.
    """
    paths: list[tuple[int, tuple[int, int]]] = [(0, (0, 64))]
    for _ in range(level):
        paths = [v for p in paths for v in _variants(*p)]
    return [_variants(*p) for p in paths]


def _variants(fixed: int, left: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
    one, two = _halves(*left)
    return [(fixed | _left_out(*seg, bit), other)
            for seg, other in ((one, two), (two, one)) for bit in range(seg[0], seg[0] + seg[1])]


def variants(rows: DataFrame, level: int) -> DataFrame:
    """The next variants of ``path, fp`` rows (level 0: path 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([[m for m, _ in kids] for kids in _children(level)], np.uint64)
        width = masks.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                path, fp = (part.column(i).to_numpy() for i in range(2))
                own = masks[path] & fp.view(np.uint64)[:, None]
                paths = path[:, None] * width + np.arange(width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths.reshape(-1).astype(np.int32)),
                     pa.array(own.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, width))],
                    names=["path", "fixed", "fp"])
    return rows.select(F.col("path").cast("int").alias("path"), "fp").mapInArrow(run, VARIANT)


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative, member) edges that connect what links of at most ``DISTANCE`` bits
    connect among distinct fingerprints."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= DISTANCE
    label = np.arange(len(prints))
    while True:
        least = np.where(near, label[None, :], len(prints)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(prints))
    return prints[label[moved]], prints[moved]


def solved(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of the variants of up to ``limit`` fingerprints; the rows of larger ones
    as they are (``a`` the fingerprint, ``path`` its variant), streamed, never held."""
    def links(path: np.ndarray, fixed: np.ndarray, fp: np.ndarray):
        new = np.ones(len(fp), bool)
        new[1:] = (path[1:] != path[:-1]) | (fixed[1:] != fixed[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [fp[:0]], [fp[:0]]
        two = starts[sizes == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= DISTANCE
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = forest(fp[s:s + n].view(np.uint64))
            a.append(x.view(np.int64))
            b.append(y.view(np.int64))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return made(both[0], both[1], None)

    def made(a, b, path) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()),
             pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()),
             pa.nulls(len(a), pa.int32()) if path is None else pa.array(path, pa.int32())],
            names=["a", "b", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)]
        hot: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_numpy() for i in range(3)]
            path, fixed, fp = [np.concatenate([h, o]) for h, o in zip(held, own)]
            if hot is not None:
                n = int(((path == hot[0]) & (fixed == hot[1])).sum())  # they come first
                yield made(fp[:n], None, path[:n])
                path, fixed, fp = path[n:], fixed[n:], fp[n:]
                if len(fp):
                    hot = None
            if len(fp):
                last = (path == path[-1]) & (fixed == fixed[-1])
                cut = len(fp) - int(last.sum())
                yield from _split(path[:cut], fixed[:cut], fp[:cut])
                path, fixed, fp = path[cut:], fixed[cut:], fp[cut:]
                if len(fp) > limit:
                    hot = (int(path[0]), int(fixed[0]))
                    yield made(fp, None, path)
                    path, fixed, fp = path[:0], fixed[:0], fp[:0]
            held = [path, fixed, fp]
        if len(held[0]):
            yield links(*held)

    def _split(path, fixed, fp) -> Iterator[pa.RecordBatch]:
        """Complete variants: the large ones as rows, of the others the links."""
        if not len(fp):
            return
        new = np.ones(len(fp), bool)
        new[1:] = (path[1:] != path[:-1]) | (fixed[1:] != fixed[:-1])
        sizes = np.diff(np.append(np.flatnonzero(new), len(fp)))
        large = np.repeat(sizes > limit, sizes)
        if large.any():
            yield made(fp[large], None, path[large])
        yield links(path[~large], fixed[~large], fp[~large])

    return rows.repartition("path", "fixed").sortWithinPartitions("path", "fixed").mapInArrow(
        run, FOUND)


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as the pairs of at
    most ``DISTANCE`` differing bits do."""
    rows, edges = prints.select(F.lit(0).alias("path"), "fp"), None
    for level in range(3):
        last = level == 2  # 11 free bits: 2048 fingerprints at most
        found = stored(solved(variants(rows, level), max(limit, 2048) if last else limit),
                       "simhash-links")
        own = found.where("path is null").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        rows = found.where("path is not null").select("path", F.col("a").alias("fp"))
        if last or rows.isEmpty():
            return edges.distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``, with ``n``: its rows).

    Keys with more than 1 / ``HOT_SHARE`` of the ``total`` rows are fewer than ``HOT_SHARE``:
    they are broadcast, so a key of a third of all rows never meets in one task.
    """
    hot = F.col("n") * HOT_SHARE > total
    few = F.broadcast(table.where(hot).drop("n"))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~hot).drop("n"), key))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row."""
    prints = stored(fingerprints(docs), "simhash-prints")
    groups = stored(prints.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    labels = components(links(groups.select("fp"), limit)).withColumnRenamed("node", "fp")
    sums = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    labelled = groups.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of_label = labelled.groupBy("label").agg(
        F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = stored(looked_up(labelled.select("label", "fp", F.col("n").alias("docs")), of_label,
                             "label", sums[0]).select(
        "fp", "component_id", F.col("docs").alias("n")), "simhash-named")
    return looked_up(prints, named, "fp", sums[1] or 0).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
