"""Attentive pooling with weights (J2): one query attends over the vectors of a group, per head,
then residual, layer norm and MLP.

No group is ever collected. Tasks multiply their vectors with the key and value matrices and
reduce each group of a batch to a partial softmax per head – running maximum, denominator and
weighted value sum. Spark merges partials by rescaling them to the group's maximum in two
aggregations, so a group of a third of all vectors is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .probe import _matrix

NORM_EPS = 1e-5
_PARTIAL = "grp long, head int, m double, l double, acc array<double>"


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


ACTIVATIONS = {"gelu": _gelu, "relu": lambda x: np.maximum(x, 0.0)}


@dataclass
class PoolerWeights:
    """The matrices of a pooler, (out x in), and its query; absent biases are 0, absent norm
    scales 1. Without ``fc1`` only the attention is applied (no residual, norm or MLP)."""

    query: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    heads: int
    fc1: np.ndarray | None = None
    fc2: np.ndarray | None = None
    bias: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, np.ndarray] = field(default_factory=dict)
    activation: str = "gelu"

    def __post_init__(self) -> None:
        if len(self.query) % self.heads:
            raise ValueError("the width must be a multiple of the heads")

    def linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ getattr(self, name).T + self.bias.get(name, 0.0)

    def norm(self, name: str, x: np.ndarray) -> np.ndarray:
        if self.fc1 is None:
            return x
        mean = x.mean(-1, keepdims=True)
        spread = np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + NORM_EPS)
        return (x - mean) / spread * self.scale.get(name, 1.0) + self.bias.get(name, 0.0)


def weights_from_table(table: DataFrame, heads: int, activation: str = "gelu") -> PoolerWeights:
    """A pooler from rows ``name, i, j, value``: the matrices by name, biases as ``b_<name>``
    and norm scales as ``s_<name>`` with ``j`` 0, the query as ``query``. The table is a model:
    its size does not grow with the data."""
    rows = table.select("name", "i", "j", F.col("value").cast("double").alias("value")).collect()
    found: dict[str, np.ndarray] = {}
    for name in {r["name"] for r in rows}:
        own = [(r["i"], r["j"], r["value"]) for r in rows if r["name"] == name]
        out = np.zeros((max(i for i, _, _ in own) + 1, max(j for _, j, _ in own) + 1))
        for i, j, value in own:
            out[i, j] = value
        found[name] = out
    part = lambda p: {n[2:]: x[:, 0] for n, x in found.items() if n.startswith(p)}
    return PoolerWeights(found["query"][:, 0], found["q"], found["k"], found["v"], heads,
                         found.get("fc1"), found.get("fc2"), part("b_"), part("s_"), activation)


def attentive_pooler(df: DataFrame, group: str, vec: str, weights: PoolerWeights) -> DataFrame:
    """``group, pooled`` (array<double>): the pooled vector of every group (a whole number).

    A NULL group is a group of its own. Vectors that are NULL, hold a NULL or have another
    width than the weights are left out; a group without any is left out.
    """
    heads, width = weights.heads, len(weights.query)
    size = width // heads
    query = weights.linear("q", weights.query).reshape(heads, size) * size ** -0.5

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1))
            if not len(rows):
                continue
            groups = batch.column(0).take(pa.array(rows)).dictionary_encode("encode")
            normed = weights.norm("norm1", x)
            key = weights.linear("k", normed).reshape(-1, heads, size)
            value = weights.linear("v", normed).reshape(-1, heads, size)
            score = np.einsum("nhd,hd->nh", key, query)
            code = groups.indices.to_numpy()
            n = len(groups.dictionary)
            most = np.full((n, heads), -np.inf)
            np.maximum.at(most, code, score)
            e = np.exp(score - most[code])
            total, acc = np.zeros((n, heads)), np.zeros((n, heads, size))
            np.add.at(total, code, e)
            np.add.at(acc, code, e[:, :, None] * value)
            yield pa.RecordBatch.from_arrays(
                [groups.dictionary.take(pa.array(np.repeat(np.arange(n), heads))),
                 pa.array(np.tile(np.arange(heads, dtype=np.int32), n)),
                 pa.array(most.reshape(-1)), pa.array(total.reshape(-1)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n * heads + 1) * size, pa.int32()),
                                          pa.array(acc.reshape(-1)))],
                names=["grp", "head", "m", "l", "acc"])
    rows = df.select(F.col(group).cast("long").alias("grp"), F.col(vec).alias("vec")).where(
        F.size("vec") == width)
    parts = rows.mapInArrow(partial, _PARTIAL)
    top = parts.groupBy("grp", "head").agg(F.max("m").alias("top")).select(
        F.col("grp").alias("g"), F.col("head").alias("h"), "top")
    scaled = parts.join(top, F.col("grp").eqNullSafe(F.col("g")) & (F.col("head") == F.col("h")))
    scaled = scaled.withColumn("f", F.exp(F.col("m") - F.col("top")))
    sums = scaled.select("grp", "head", (F.col("l") * F.col("f")).alias("l"), F.posexplode(
        F.transform("acc", lambda a: a * F.col("f"))).alias("d", "a")).groupBy(
        "grp", "head", "d").agg((F.sum("a") / F.sum("l")).alias("y"))
    # a vector's width: one row per group
    pooled = sums.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("head", "d", "y"))), lambda s: s["y"]).alias("y"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), float).reshape(-1, width)
            if weights.fc1 is not None:
                y = weights.query + y
                hidden = ACTIVATIONS[weights.activation](
                    weights.linear("fc1", weights.norm("norm2", y)))
                y = y + weights.linear("fc2", hidden)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(y) + 1) * width, pa.int32()), pa.array(y.reshape(-1)))],
                names=["grp", "pooled"])
    return pooled.mapInArrow(finish, "grp long, pooled array<double>").withColumnRenamed(
        "grp", group)
