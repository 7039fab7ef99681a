"""Probes on frozen embeddings and batch inference hooks.

Embeddings are ``ARRAY<FLOAT>`` columns. Scores against a class table are a block matrix
product: vectors in packed chunks, classes in packed blocks, each pair of them one numpy step
in a task, so neither side ever is one row or one broadcast, whatever the number of classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_table

#: Vectors of a packed chunk and classes of a packed block.
CHUNK_ROWS = 1024
BLOCK_CLASSES = 256


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(values: Column | str) -> Column:
    """0-based index of the largest value (first one on ties)."""
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def centroids(train: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-class mean vector, as ``(label, centroid ARRAY<DOUBLE>)``.

    The mean is taken per (class, dimension) with partial aggregation, so a class with
    a third of the rows is pre-aggregated on every executor before the shuffle.
    """
    per_dim = (train.select(label, F.posexplode(vec).alias("i", "x"))
               .groupBy(label, "i").agg(F.avg("x").alias("m")))
    return per_dim.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
        .alias("centroid"))


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, accumulated in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the first valid row's length as a matrix, and which rows they are. NULL
    vectors and those with a NULL component are left out."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    width = next((int(n) for n in size if n > 0), 0)
    rows = np.flatnonzero(size == width) if width else np.zeros(0, np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()) if width else None
    out = np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(-1, width) if width else \
        np.zeros((0, 0))
    good = ~np.isnan(out).any(1) if width else np.zeros(0, bool)
    return out[good], rows[good]


def _packed(df: DataFrame, rows: int, names: tuple[str, str, str]) -> DataFrame:
    """``names`` = (first key, second key, matrix): up to ``rows`` vectors of ``df`` (long,
    long, list) as one row."""
    schema = f"{names[0]} array<long>, {names[1]} array<long>, {names[2]} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values, good = _matrix(part.column(2))
                if len(good):
                    keys = [pa.array([part.column(i).take(pa.array(good)).to_pylist()],
                                     pa.list_(pa.int64())) for i in range(2)]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array([values.tobytes()], pa.binary())], names=list(names))
    return df.mapInArrow(run, schema)


def class_scores(df: DataFrame, cents: DataFrame, key: str, label: str = "label",
                 vec: str = "embedding") -> DataFrame:
    """Per row of ``df`` (``key``: its distinct long id) ``prediction``, ``log_sum`` and
    ``target_logit``, where the logit of a class is minus the squared distance to its centroid.

    ``prediction``: the class with the largest logit (the smallest class on ties);
    ``log_sum``: logsumexp over all classes; ``target_logit``: that of the row's own label
    (NULL if there is no such class). Labels are whole numbers. Rows whose vector is NULL or
    has a NULL component are left out. Chunks of vectors meet blocks of classes; per-block
    results are merged by an aggregation over the rows.
    """
    rows = lambda t, a, b, v: t.select(F.col(a).cast("long").alias("a"),
                                       F.col(b).cast("long").alias("b"), F.col(v).alias("v"))
    chunks = _packed(rows(df, key, label, vec), CHUNK_ROWS, ("keys", "own", "x"))
    blocks = _packed(rows(cents, label, label, "centroid"), BLOCK_CLASSES,
                     ("classes", "again", "c")).drop("again")
    schema = "key long, best double, class long, log_sum double, target double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                classes = np.array(row["classes"])
                order = np.argsort(classes)
                classes = classes[order]
                x = np.frombuffer(row["x"]).reshape(len(row["keys"]), -1)
                c = np.frombuffer(row["c"]).reshape(len(classes), -1)[order]
                z = -np.stack([((x - one) ** 2).sum(1) for one in c], 1)
                at = z.argmax(1)
                top = z.max(1)
                own = np.array([np.nan if v is None else v for v in row["own"]], float)
                spot = np.minimum(np.searchsorted(classes, own), len(classes) - 1)
                known = classes[spot] == own
                target = z[np.arange(len(z)), spot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(top), pa.array(classes[at]),
                     pa.array(top + np.log(np.exp(z - top[:, None]).sum(1))),
                     pa.array(target, mask=~known)],
                    names=["key", "best", "class", "log_sum", "target"])
    met = chunks.crossJoin(blocks).mapInArrow(run, schema)  # every vector meets every class
    merged = met.groupBy("key").agg(
        F.max(F.struct("best", (-F.col("class")).alias("c"))).alias("top"),
        F.collect_list("log_sum").alias("sums"),  # one per block of classes
        F.max("target").alias("target_logit"))
    most = F.array_max("sums")
    total = F.aggregate("sums", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("sums")))
    return merged.select(F.col("key").alias(key), (-F.col("top.c")).alias("prediction"),
                         (most + F.log(total)).alias("log_sum"), "target_logit")


def nearest_centroid(df: DataFrame, cents: DataFrame, key: str, vec: str = "embedding",
                     label: str = "label") -> DataFrame:
    """J1 (nearest-centroid form) + J3: ``df`` with the predicted class."""
    found = class_scores(df, cents, key, label, vec).select(key, "prediction")
    return df.join(found, key, "left")


def cross_entropy(logits: Column, target_idx: Column) -> Column:
    """``logsumexp(logits) - logits[target]`` (max-shifted)."""
    mx = F.array_max(logits)
    lse = mx + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
    return lse - F.element_at(logits, (target_idx + 1).cast("int"))


def epoch_loss(per_row: DataFrame, batch: str, loss: str, by: list[str] = ()) -> DataFrame:
    """loss = mean of the **batch** means (a short last batch weighs as much as a
    full one), accuracy-style counts row weighted."""
    b = per_row.groupBy(*by, batch).agg(F.avg(loss).alias("batch_loss"),
                                        F.count(F.lit(1)).alias("n"))
    return b.groupBy(*by).agg(F.avg("batch_loss").alias("loss"), F.sum("n").alias("rows"))


def attentive_pool(df: DataFrame, group: str, vec: str, query: list[float]) -> DataFrame:
    """J2 (single head, given query): per group ``Σ softmax(q·k/√d)_i · v_i``.

    Two partial aggregations (max score, then weighted sums per dimension) – no group is
    ever collected, so a hot group is split across tasks.
    """
    d = len(query)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(group, vec, (F.aggregate(F.zip_with(F.col(vec), q, lambda a, b: a * b),
                                                F.lit(0.0), lambda acc, x: acc + x)
                                    / F.lit(d ** 0.5)).alias("_s"))
    mx = scored.groupBy(group).agg(F.max("_s").alias("_m"))
    w = scored.join(mx, on=group).withColumn("_w", F.exp(F.col("_s") - F.col("_m")))
    den = w.groupBy(group).agg(F.sum("_w").alias("_den"))
    num = (w.select(group, "_w", F.posexplode(vec).alias("dim", "x"))
           .groupBy(group, "dim").agg(F.sum(F.col("_w") * F.col("x")).alias("_num")))
    return num.join(den, on=group).select(group, "dim", (F.col("_num") / F.col("_den"))
                                          .alias("value"))


def trained_probe(rows: DataFrame, epochs: int, rate: float, vec: str = "embedding",
                  label: str = "label", part: str = "part") -> DataFrame:
    """J1 (trained form): multinomial logistic regression by full gradient steps, from zero.

    ``rows``: vectors with a whole-number label and their ``part`` ('train', 'validation' or
    'test'). Every epoch is one pass: tasks score their vectors with the weights of the last
    step and give partial losses, hits and gradients, which Spark sums per (class, dimension);
    the step is then taken on the summed table. Only the model (classes x dimensions) is ever
    held as a whole.

    One row per epoch: ``train_loss`` and the accuracies of the three parts after its step
    (NULL for an empty part), and ``is_best`` for the earliest epoch with the best validation
    accuracy – the one whose test accuracy counts. Vectors that are NULL, hold a NULL or differ
    in length from the first class's vectors are left out, as are NULL labels.
    """
    spark = rows.sparkSession
    data = stored_table(rows.select(F.col(label).cast("long").alias("label"),
                                    F.col(part).alias("part"), F.col(vec).alias("vec")).where(
        "label is not null and vec is not null and not exists(vec, x -> x is null)"), "probe-rows")
    shape = data.where("part = 'train'").groupBy("label").agg(F.max(F.size("vec")).alias("d"))
    shape = shape.orderBy("label").collect()  # the model's own shape: one row per class
    classes = np.array([r["label"] for r in shape], np.int64)
    width = shape[0]["d"] if shape else 0
    data = data.where(F.size("vec") == width)
    weights = np.zeros((len(classes), width + 1))
    table = []
    for epoch in range(epochs + 1 if len(classes) else 0):
        found = _probe_pass(data, classes, weights, with_gradient=epoch < epochs)
        sums = {r["part"]: r for r in found.where("class is null").groupBy("part").agg(
            F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("value").alias("loss"))
            .collect()} if epoch else {}
        share = lambda p: float(sums[p]["hits"]) / sums[p]["n"] if p in sums else None
        if epoch:
            loss = float(sums["train"]["loss"]) / sums["train"]["n"] if "train" in sums else None
            table.append((epoch, loss, share("train"), share("validation"), share("test")))
        if epoch < epochs:
            steps = found.where("class is not null").groupBy("class", "dim").agg(
                F.sum("value").alias("g"), F.sum("n").alias("n")).collect()
            for r in steps:  # the model's size, not the data's
                weights[r["class"], r["dim"]] -= rate * r["g"] / r["n"]
    best = max((r[3] for r in table if r[3] is not None), default=None)
    first = next((r[0] for r in table if best is not None and r[3] == best), None)
    return spark.createDataFrame(
        [(*r, r[0] == first) for r in table],
        "epoch int, train_loss double, train_accuracy double, val_accuracy double, "
        "test_accuracy double, is_best boolean")


def _probe_pass(data: DataFrame, classes: np.ndarray, weights: np.ndarray,
                with_gradient: bool) -> DataFrame:
    """Partial sums of one pass: rows (part, n, hits, value = loss) per task and part, and rows
    (class, dim, n, value = gradient) per task over the training vectors."""
    schema = "part string, class int, dim int, n long, hits long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: dict[str, list[float]] = {}
        gradient, n_train = np.zeros_like(weights), 0
        for batch in batches:
            x, rows = _matrix(batch.column(2))
            if not len(rows):
                continue
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            label = batch.column(0).to_numpy()[rows]
            part = np.array(batch.column(1).to_pylist(), object)[rows]
            spot = np.minimum(np.searchsorted(classes, label), len(classes) - 1)
            known = classes[spot] == label
            z = x @ weights.T
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            hit = known & (z.argmax(1) == spot)
            loss = np.where(known, -np.log(p[np.arange(len(p)), spot]), 0.0)
            for name in set(part.tolist()):
                own = part == name
                old = stats.setdefault(name, [0, 0, 0.0])
                stats[name] = [old[0] + int(own.sum()), old[1] + int(hit[own].sum()),
                               old[2] + float(loss[own].sum())]
            train = part == "train"
            if with_gradient and train.any():
                p = p[train]
                p[np.arange(len(p)), spot[train]] -= 1.0
                gradient += p.T @ x[train]
                n_train += int(train.sum())
        names = list(stats)
        n, hits, loss = ([stats[k][i] for k in names] for i in range(3))
        grid = np.indices(weights.shape).reshape(2, -1) if n_train else np.zeros((2, 0), int)
        size = grid.shape[1]
        none = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + [None] * size, pa.string()),
             pa.array([None] * len(names) + grid[0].tolist(), pa.int32()),
             pa.array([None] * len(names) + grid[1].tolist(), pa.int32()),
             pa.array(n + [n_train] * size, pa.int64()), pa.array(hits + [0] * size, pa.int64()),
             pa.array(loss + gradient.reshape(-1).tolist()[:size], pa.float64())],
            names=["part", "class", "dim", "n", "hits", "value"])
    return data.mapInArrow(run, schema)



def batch_predict(df: DataFrame, predictor: Callable[[list[str]], list[str]],
                  text_col: str = "prompt", out_col: str = "generated_text",
                  error_value: str = "error_empty_input_ids",
                  batch_col: str = "batch") -> DataFrame:
    """Run a user predictor over the texts of ``df``. All rows of a batch (``batch_col``,
    see :func:`gradebook.operators.evaluation.batch_accuracy`) that holds an empty or NULL
    text get the error sentinel, as in the evaluator; the other rows go through the predictor
    in Arrow batches, so the answer does not depend on how Spark cuts them."""
    empty = F.coalesce(F.col(text_col) == "", F.lit(True))
    spoiled = df.groupBy(F.col(batch_col).alias("_of")).agg(F.max(empty).alias("_spoiled"))
    marked = df.join(spoiled, F.col(batch_col).eqNullSafe(F.col("_of"))).drop("_of")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = ~pdf.pop("_spoiled").to_numpy(bool)
            outs = np.full(len(pdf), error_value, object)
            if good.any():
                outs[good] = list(predictor(pdf.loc[good, text_col].tolist()))
            yield pdf.assign(**{out_col: outs})

    return marked.mapInPandas(run, schema)


def model_scores(df: DataFrame, scorer: Callable[[list[str]], list[float]],
                 prompt_col: str = "prompt", completion_col: str = "completion",
                 out_col: str = "reward") -> DataFrame:
    """A reward model's score of every prompt with its completion (NULL texts: empty), in
    Arrow batches. ``scorer`` takes the joined texts and returns one number each."""
    whole = F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in (prompt_col, completion_col)])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("_whole").tolist()
            yield pdf.assign(**{out_col: np.asarray(scorer(texts) if texts else [], float)})

    return df.withColumn("_whole", whole).mapInPandas(run, schema)


def gather_by_index(patches: Column, idx: Column) -> Column:
    """Keep the listed items of an array, in the order of ``idx`` (0-based)."""
    return F.transform(idx, lambda i: F.element_at(patches, i + 1))


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row repeated ``times`` times (with its copy number)."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))
