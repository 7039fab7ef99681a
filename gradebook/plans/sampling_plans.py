"""Sampling plans over ``documents`` (survey build step 8: G4-G7, G9, H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sampling as sm
from ..session import table

SEED = 42


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source")


def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded md5 permutation of all documents with 1-based positions."""
    return sm.shuffle(_docs(spark, sf_dir), "doc_id", SEED).select("doc_id", "perm_pos")


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 10 % validation split (int(n * 0.1) rows), the rest train."""
    return sm.exact_split(_docs(spark, sf_dir), "doc_id", 0.1, SEED).select("doc_id", "split")


def grouped_sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sampler with mini_repeat 4, batch 8, repeat 2."""
    return sm.group_sampler(_docs(spark, sf_dir), "doc_id", mini_repeat=4, batch_size=8,
                            repeat=2, seed=SEED)


def repeated_sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat sampler, each document 3 times in a row."""
    return sm.repeat_sampler(_docs(spark, sf_dir), "doc_id", 3, SEED)


def incomplete_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 + H4: sources whose document count differs from 50 (a group-size check), in
    source order."""
    bad = sm.check_group_sizes(_docs(spark, sf_dir), "source", 50)
    return bad.orderBy("source")
