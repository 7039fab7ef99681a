"""Probe plans over ``embeddings`` (survey build step 15: J1-J4, G5, G10, E1, E8, E12).

Split: exact 10 % validation by md5 permutation of ``vec_id`` (G5). Nearest-centroid
probe (class means of the training part), attentive pooling per class with a fixed
all-ones query, cross-entropy of the centroid logits in batches of 64 (mean of batch
means), and a multinomial logistic probe trained by gradient steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pooling as pl
from ..operators import probe as pb
from ..operators.ranking import numeric_block, positions
from ..operators.sampling import exact_split
from ..session import table

BATCH = 64
EPOCHS = 4
RATE = 4.0
ROUND = 6


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return exact_split(emb, "vec_id", 0.1, 42)


def centroid_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation accuracy per class of the nearest-centroid probe."""
    s = _split(spark, sf_dir)
    cents = pb.centroids(s.filter(F.col("split") == "train"))
    pred = pb.nearest_centroid(s.filter(F.col("split") == "validation"), cents, "vec_id")
    return pred.groupBy("label").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("prediction") == F.col("label")).alias("correct_predictions"))


def attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax-attention pooled vector per class, long form."""
    emb = table(spark, sf_dir, "embeddings").select("label", "embedding")
    pooled = pb.attentive_pool(emb, "label", "embedding", [1.0] * 64)
    return pooled.select("label", "dim", F.round("value", ROUND).alias("value"))


#: Fixed values of the pooler plan: width, hidden width, heads, and per matrix its (rows,
#: columns, multiplier) of the value (i * multiplier + j * 7 + 3) % 13 - 6, over 50.
WIDTH, HIDDEN, HEADS = 64, 128, 4
MATRICES = {"query": (WIDTH, 1, 5), "q": (WIDTH, WIDTH, 11), "k": (WIDTH, WIDTH, 17),
            "v": (WIDTH, WIDTH, 23), "fc1": (HIDDEN, WIDTH, 29), "fc2": (WIDTH, HIDDEN, 31),
            "b_v": (WIDTH, 1, 19), "b_fc1": (HIDDEN, 1, 37)}


def pooler_table(spark: SparkSession) -> DataFrame:
    """The weights of the pooler plan as ``name, i, j, value``."""
    parts = [spark.range(n * m).select(
        F.lit(name).alias("name"), F.floor(F.col("id") / m).alias("i"),
        (F.col("id") % m).alias("j")).withColumn(
        "value", ((F.col("i") * by + F.col("j") * 7 + 3) % 13 - 6) / 50.0)
        for name, (n, m, by) in MATRICES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attentive_pooler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-head attention of one query over the vectors of a class, residual and MLP."""
    emb = table(spark, sf_dir, "embeddings").select("label", "embedding")
    weights = pl.weights_from_table(pooler_table(spark), HEADS, "relu")
    pooled = pl.attentive_pooler(emb, "label", "embedding", weights)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).select(
        "label", "dim", F.round("value", ROUND).alias("value"))


def probe_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the centroid logits, per batch of 64 in vec_id order and the
    mean of batch means (J4 F9 E8)."""
    s = _split(spark, sf_dir)
    cents = pb.centroids(s.filter(F.col("split") == "train"))
    scores = pb.class_scores(s, cents, "vec_id")
    rows = s.select("split", "vec_id").join(scores, "vec_id").select(
        "split", "vec_id", (F.col("log_sum") - F.col("target_logit")).alias("ce"))
    ranked = positions(rows, ["split"], ["vec_id"], numeric_block("vec_id", 1 << 16), "pos",
                       levels=2)
    batched = ranked.withColumn("batch", F.floor((F.col("pos") - 1) / F.lit(BATCH)).cast("long"))
    per_batch = batched.groupBy("split", "batch").agg(F.avg("ce").alias("batch_loss"),
                                                      F.count(F.lit(1)).alias("n"))
    overall = pb.epoch_loss(batched, "batch", "ce", ["split"])
    return (per_batch.join(overall.select("split", "loss"), on="split")
            .select("split", "batch", "n", F.round("batch_loss", ROUND).alias("batch_loss"),
                    F.round("loss", ROUND).alias("split_loss")))


def logistic_probe_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic probe (J1 E12): loss and accuracies after each epoch, the earliest
    best one marked. A tenth of the vectors is for validation, a tenth for the test."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    part = F.when(F.col("vec_id") % 10 == 0, "validation").when(
        F.col("vec_id") % 10 == 1, "test").otherwise("train")
    found = pb.trained_probe(emb.withColumn("part", part), EPOCHS, RATE)
    rounded = [F.round(c, ROUND).alias(c) for c in (
        "train_loss", "train_accuracy", "val_accuracy", "test_accuracy")]
    return found.select("epoch", *rounded, "is_best")
