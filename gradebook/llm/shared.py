"""Shared-folder tables for intermediate results of the training-data operators.

Intermediate tables are Parquet files below the folder named in ``spark.checkpoint.dir``,
so every executor and the driver see them and a lost executor costs no recomputation of
the stages before them. Nothing here touches a machine-local folder on a cluster.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY_BITS = 18  # 16 million bits, 2 MB

def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made only for a single-machine session
    (``local[...]``, as in tests); any other session must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gradebook-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it reread.

    The reread table has a known size, so Catalyst broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be a value of ``wanted`` (one column): all that are, and
    few others. Put before a join that shuffles ``df``.

    The values are told to the tasks as bits of a table of at most ``1 << KEY_BITS`` longs, so
    the broadcast is bounded; with more values than bits more other rows stay.
    """
    from pyspark.sql import functions as F

    def place(name: str):
        hashed = F.xxhash64(f"`{name}`")
        return hashed.bitwiseAND((1 << KEY_BITS) - 1), F.shiftrightunsigned(hashed, 58).cast("int")
    word, bits = free_name(df, "_word"), free_name(df, "_bits")
    at, bit = place(wanted.columns[0])
    table = wanted.select(at.alias(word), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit).alias(bits)).groupBy(word).agg(
        F.bit_or(bits).alias(bits))
    at, bit = place(key)
    return df.withColumn(word, at).join(F.broadcast(table), word).where(
        F.bit_get(F.col(bits), bit) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def columns_or_null(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select ``wanted`` (name -> type), adding absent columns as typed NULL."""
    from pyspark.sql import functions as F

    return df.select(*[
        (F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
        for c, t in wanted.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and is not used by ``df``."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps.

    The cleaner acts when the JVM has collected a step's plan; in a short driver program
    that may be never, and all steps' shuffle files would stay until the end. The first
    round frees what Python still names, the second what the JVM held for it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
