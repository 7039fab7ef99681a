"""Nearest neighbours by shifted Hilbert curves, with a certified finish.

1. Vectors are normalised. For each of ``CURVES`` orders they are projected onto ``DIMS``
   random orthonormal directions, shifted by a random offset and placed on a Hilbert curve.
2. Spark range-partitions each order by the curve key. In a sorted run each query reads its
   ``WINDOW`` neighbours on both sides; the windows of all orders merge and are ranked by the
   exact cosine. The k-th best is a lower bound of the query's true k-th best.
3. In the first order the sorted runs are cut into blocks of ``BLOCK`` rows with their mean
   direction and angular radius. A block is scanned for a query only if, by the triangle
   inequality of angles, it may hold a vector at or above the query's bound. Without local
   structure no block can be excluded and all are scanned, in blocks; with it few are. The
   result is exact either way.

Equal vectors are collapsed first: only the ``k + 1`` smallest ids of one vector can be in a
result, so the others are left out before any search (they are still queries of their own).

Scores are cosines in double precision, summed in component order; results are ordered by
score, ties by smaller id.

Defined cases: vectors that are NULL, zero, or hold NULL, NaN or infinite components, and
rows without an id, take no part; vectors of different lengths are never compared; rows that
repeat an id and its vector count once; fewer candidates than ``k`` give all of them; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

CURVES = 4
DIMS = 8
BITS = 7
WINDOW = 64
BLOCK = 2048
QUERY_BLOCK = 1024
SEED = 11
SLACK = 1e-9
PAIR = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows x dims, ``bits`` bits each), by
    transposing the coordinates and undoing the rotations of each bit plane."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Curve key of unit vectors under the projection and shift of one order."""
    dim = unit.shape[1]
    rng = np.random.default_rng([SEED, curve, dim])
    axes = np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))[0]
    shift = rng.random(axes.shape[1])
    spread = 3.0 / np.sqrt(dim)
    place = np.clip((unit @ axes) / spread * 0.5 + 0.5, 0, 1)
    cells = ((place + shift) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of float64 vectors of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine; products and squares are added in component order."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _top(query_ids, vec_ids, scores, k: int):
    """Indices of each query's k best (score down, id up)."""
    order = np.lexsort((vec_ids, -scores, query_ids))
    q = query_ids[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _pairs(query_ids, vec_ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(vec_ids, pa.int64()),
         pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])


def prepare(df: DataFrame, vec_id: str, embedding: str, is_query: Column) -> DataFrame:
    """``vec_id, dim, vec (float64 bytes), is_query, candidate`` of the usable rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed, asked = [], [], [], []
            for i, v, q in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if i is None or not v or any(x is None for x in v):
                    continue
                row = np.array(v, np.float64)
                norm = float(row @ row) if np.isfinite(row).all() else 0.0
                if norm > 0 and np.isfinite(norm):
                    ids.append(i)
                    dims.append(len(row))
                    packed.append((row + 0.0).tobytes())
                    asked.append(bool(q))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()),
                 pa.array(packed, pa.binary()), pa.array(asked, pa.bool_())],
                names=["vec_id", "dim", "vec", "is_query"])
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"),
                     F.col(embedding).cast("array<double>").alias("v"),
                     is_query.alias("is_query"))
    return rows.mapInArrow(pack, "vec_id long, dim int, vec binary, is_query boolean")


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest rows but its own."""
    rows = stored(prepare(df, vec_id, embedding, is_query), "ann-rows")
    rows = rows.groupBy("vec", "dim", "vec_id").agg(F.max("is_query").alias("is_query"))
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "dim",
                                            F.col("vec").alias("query"))
    few = Window.partitionBy("vec").orderBy("vec_id")
    held = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    base = stored(held.select("vec_id", "dim", "vec", F.lit(False).alias("is_query")).unionByName(
        queries.select(F.col("query_id").alias("vec_id"), "dim", F.col("query").alias("vec"),
                       F.lit(True).alias("is_query"))), "ann-base")

    keyed = base.mapInArrow(_keyed, "curve int, dim int, key long, vec_id long, vec binary, "
                                    "is_query boolean")
    # Curve 0 is used twice: for its windows and as the blocks of the finish.
    runs = keyed.repartitionByRange("curve", "dim", "key").sortWithinPartitions(
        "curve", "dim", "key", "vec_id")
    found = runs.mapInArrow(lambda b: _windows(b, k), PAIR).groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = stored(found.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k), "ann-near")
    bounds = near.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("bound"))

    blocks = stored(runs.where("curve = 0 and not is_query").mapInArrow(
        _blocks, "block string, dim int, centre binary, cos_radius double, ids binary, "
                 "vecs binary"), "ann-blocks")
    asked = queries.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(-2.0)))
    number = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(
        F.col("total") / QUERY_BLOCK)))
    total = asked.agg(F.count(F.lit(1)).alias("total"))
    asked = asked.crossJoin(F.broadcast(total)).withColumn("query_block", number).drop("total")
    asked = stored(asked.repartition("dim", "query_block").sortWithinPartitions(
        "dim", "query_block").mapInArrow(
        _query_blocks, "dim int, queries binary, query_ids binary, bounds binary"), "ann-queries")
    scanned = blocks.repartition("block").join(
        asked, "dim").mapInArrow(
        lambda b: _scan(b, k), PAIR)
    merged = scanned.unionByName(near.select("query_id", "vec_id", "score")).groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            m = _matrix(part.column(2))
            unit = m / np.linalg.norm(m, axis=1, keepdims=True)
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), curve, np.int32)), part.column(1),
                     pa.array(curve_keys(unit, curve)), part.column(0), part.column(2),
                     part.column(3)],
                    names=["curve", "dim", "key", "vec_id", "vec", "is_query"])


def _runs(batches: Iterator[pa.RecordBatch], size: int, overlap: int):
    """Consecutive rows of one (curve, dim) in pieces of ``size`` rows that also hold the
    ``overlap`` rows before and after: (piece, own start, own end)."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches(
            [held, batch]).combine_chunks().to_batches()[0]
        while held.num_rows:
            tags = held.column(0).to_numpy().astype(np.int64) << 32 | held.column(1).to_numpy()
            change = np.flatnonzero(tags[1:] != tags[:-1])
            end = int(change[0]) + 1 if len(change) else held.num_rows
            if not len(change) and end < size + 2 * overlap:
                break
            for a in range(0, end, size):
                yield (held.slice(max(0, a - overlap), min(end, a + size + overlap)
                                  - max(0, a - overlap)),
                       min(a, overlap), min(a, overlap) + min(size, end - a))
            held = held.slice(end)
    if held is not None and held.num_rows:
        end = held.num_rows
        for a in range(0, end, size):
            low = max(0, a - overlap)
            yield (held.slice(low, min(end, a + size + overlap) - low),
                   a - low, a - low + min(size, end - a))


def _windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for piece, a, b in _runs(batches, BLOCK, WINDOW):
        asked = np.flatnonzero(piece.column(5).to_numpy(zero_copy_only=False))
        asked = asked[(asked >= a) & (asked < b)]
        if not len(asked):
            continue
        m, ids = _matrix(piece.column(4)), piece.column(3).to_numpy()
        around = asked[:, None] + np.arange(-WINDOW, WINDOW + 1)[None, :]
        fine = (around >= 0) & (around < len(ids))
        q, v = np.repeat(asked, fine.sum(1)), around[fine]
        ok = (ids[q] != ids[v]) & ~piece.column(5).to_numpy(zero_copy_only=False)[v]
        q, v = q[ok], v[ok]
        if len(q):
            score = cosines(m[q], m[v])
            top = _top(ids[q], ids[v], score, k)
            yield _pairs(ids[q][top], ids[v][top], score[top])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, a, b in _runs(batches, BLOCK, 0):
        m = _matrix(piece.column(4))
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        centre = unit.mean(0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 0 else unit[0]
        ids = piece.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{ids[0]}-{ids[-1]}-{len(ids)}"]),
             pa.array([m.shape[1]], pa.int32()), pa.array([centre.tobytes()], pa.binary()),
             pa.array([float((unit @ centre).min())]), pa.array([ids.tobytes()], pa.binary()),
             pa.array([m.tobytes()], pa.binary())],
            names=["block", "dim", "centre", "cos_radius", "ids", "vecs"])


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, block = batch.column("dim").to_numpy(), batch.column("query_block").to_numpy()
        tags = dims.astype(np.int64) << 32 | block
        for tag in np.unique(tags):
            part = batch.take(pa.array(np.flatnonzero(tags == tag)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(tag >> 32)], pa.int32()),
                 pa.array([b"".join(part.column("query").to_pylist())], pa.binary()),
                 pa.array([part.column("query_id").to_numpy().tobytes()], pa.binary()),
                 pa.array([part.column("bound").to_numpy().tobytes()], pa.binary())],
                names=["dim", "queries", "query_ids", "bounds"])


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            q = np.frombuffer(row["queries"]).reshape(-1, dim)
            qids = np.frombuffer(row["query_ids"], np.int64)
            bound = np.frombuffer(row["bounds"])
            unit_q = q / np.linalg.norm(q, axis=1, keepdims=True)
            angle = np.arccos(np.clip(unit_q @ np.frombuffer(row["centre"]), -1, 1))
            reach = np.arccos(np.clip(row["cos_radius"], -1, 1))
            may = np.cos(np.maximum(0, angle - reach)) >= bound - SLACK
            if not may.any():
                continue
            m, ids = np.frombuffer(row["vecs"]).reshape(-1, dim), np.frombuffer(row["ids"], np.int64)
            unit = m / np.linalg.norm(m, axis=1, keepdims=True)
            q, qids, bound = q[may], qids[may], bound[may]
            near = unit_q[may] @ unit.T
            near[qids[:, None] == ids[None, :]] = -3
            if len(ids) > k:
                least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                bound = np.maximum(bound, least)
            a, b = np.nonzero((near >= bound[:, None] - SLACK) & (near > -2.5))
            if len(a):
                score = cosines(q[a], m[b])
                top = _top(qids[a], ids[b], score, k)
                yield _pairs(qids[a][top], ids[b][top], score[top])
