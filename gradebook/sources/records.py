"""Training-record sources and sinks.

RL JSONL records are ``{id, image?, conversations:[{from, value}], accu_reward_method?}``
where ``image`` is a path **or** a list of paths; lines are parsed to VARIANT, so either form
keeps its type, and normalised into examples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as pr

TURNS = "array<struct<`from`:string,value:string>>"

SFT_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
    T.StructField("images", T.ArrayType(T.StringType())),
])

# Class vocabularies of the labelled image sets (torchvision order).
CIFAR10_CLASSES = ["airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse",
                   "ship", "truck"]
CIFAR100_CLASSES = [
    "apple", "aquarium_fish", "baby", "bear", "beaver", "bed", "bee", "beetle", "bicycle",
    "bottle", "bowl", "boy", "bridge", "bus", "butterfly", "camel", "can", "castle",
    "caterpillar", "cattle", "chair", "chimpanzee", "clock", "cloud", "cockroach", "couch",
    "crab", "crocodile", "cup", "dinosaur", "dolphin", "elephant", "flatfish", "forest", "fox",
    "girl", "hamster", "house", "kangaroo", "keyboard", "lamp", "lawn_mower", "leopard", "lion",
    "lizard", "lobster", "man", "maple_tree", "motorcycle", "mountain", "mouse", "mushroom",
    "oak_tree", "orange", "orchid", "otter", "palm_tree", "pear", "pickup_truck", "pine_tree",
    "plain", "plate", "poppy", "porcupine", "possum", "rabbit", "raccoon", "ray", "road",
    "rocket", "rose", "sea", "seal", "shark", "shrew", "skunk", "skyscraper", "snail", "snake",
    "spider", "squirrel", "streetcar", "sunflower", "sweet_pepper", "table", "tank",
    "telephone", "television", "tiger", "tractor", "train", "trout", "tulip", "turtle",
    "wardrobe", "whale", "willow_tree", "wolf", "woman", "worm"]
MNIST_CLASSES = [str(i) for i in range(10)]
LABELLED_SETS = {"mnist": MNIST_CLASSES, "cifar10": CIFAR10_CLASSES,
                 "cifar100": CIFAR100_CLASSES}


def class_names(dataset: str) -> list[str]:
    """The class list of a labelled set; the name is case-insensitive."""
    key = dataset.lower()
    if key not in LABELLED_SETS:
        raise ValueError(f"Unsupported dataset: {dataset}")
    return list(LABELLED_SETS[key])


def classes_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``classes(label, name)`` – label is the position in the class list."""
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def read_labelled_set(spark: SparkSession, root: str, dataset: str,
                      split: str = "test") -> tuple[DataFrame, DataFrame]:
    """``(items, classes)`` of a labelled set stored as parquet
    ``<root>/<dataset>/<split>`` with at least ``(item_id, label)``."""
    names = class_names(dataset)
    items = spark.read.parquet(f"{root.rstrip('/')}/{dataset.lower()}/{split}")
    return items, classes_table(spark, names)


def read_rl_jsonl(spark: SparkSession, files: Sequence[str], image_folders: Sequence[str],
                  reward_methods: Sequence[str] | None, dataset_name: str | None,
                  template: str = pr.TEMPLATE_DEFAULT) -> DataFrame:
    """A5 + B4-B9 + H1: read RL JSONL inputs zipped by position with their image folder
    and default reward method; normalise them into examples with a prompt.

    Unequal list lengths raise (as in the trainer). Rows keep ``file_idx`` so the file
    order can be restored; rows from all inputs are concatenated (duplicates kept).
    """
    if len(files) != len(image_folders):
        raise ValueError("Number of data files must match number of image folders")
    methods = list(reward_methods) if reward_methods is not None else ["default"] * len(files)
    if len(methods) != len(files):
        raise ValueError("Number of reward methods must match number of data files")
    parts = []
    for i, (f, folder, method) in enumerate(zip(files, image_folders, methods)):
        lines = spark.read.text(f).where(F.trim("value") != "")
        get = lambda path, t: F.variant_get(F.col("v"), path, t)
        raw = lines.select(F.parse_json("value").alias("v")).select(
            get("$.id", "string").alias("id"), get("$.image", "variant").alias("image"),
            get("$.conversations", TURNS).alias("conversations"),
            get("$.accu_reward_method", "variant").alias("own"))
        method_of = F.when(F.col("own").isNull(), F.lit(method)).otherwise(
            F.variant_get(F.col("own"), "$", "string"))  # an explicit null stays NULL
        parts.append(raw.select(
            F.lit(i).alias("file_idx"), "id",
            pr.image_paths(F.col("image"), folder).alias("image_path"),
            pr.problem_from_conversations("conversations").alias("problem"),
            pr.solution_from_conversations("conversations").alias("solution"),
            method_of.alias("accu_reward_method"),
            F.lit(dataset_name).cast("string").alias("dataset_name"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    text = pr.fill_template(template, F.col("problem"))
    return out.withColumn("prompt", pr.make_prompt(F.col("image_path"), text))


def write_rl_jsonl(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Records as JSON lines, one folder per split (``split=<name>``)."""
    cols = [c for c in ("id", "image", "conversations", "accu_reward_method") if c in df.columns]
    df.select(*cols, split_col).write.mode("overwrite").partitionBy(split_col).json(path)


def write_sft_json(df: DataFrame, path: str) -> None:
    """SFT records (messages, images) as JSON lines, non-ASCII kept."""
    df.select("messages", "images").write.mode("overwrite").json(path)


def write_rollout_log(df: DataFrame, path: str) -> None:
    """Append scored completions (each row with its **own** image path and problem)."""
    df.write.mode("append").parquet(path)


def read_dataset_dir(spark: SparkSession, path: str) -> DataFrame:
    """A saved columnar dataset directory."""
    return spark.read.parquet(path)


def save_dataset_dir(df: DataFrame, path: str) -> None:
    """Save next to the input (parquet)."""
    df.write.mode("overwrite").parquet(path)
