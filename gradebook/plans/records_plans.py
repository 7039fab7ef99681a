"""Training-record plans (survey build steps 6-7).

Step 6 – ``documents`` + ``labels`` as a labelled set: the class of a document is its
language marker (label order = class order). SFT records (B1 B2 D1), RL JSONL records
with a train/test split (B3 A7), read back from the written files with per-file image
folders and default reward methods (A5 B4-B9 D7 H1).

Step 7 – ``conversations``: flattened prompts (B20) and chain-of-thought records built
by concatenating turns into tagged responses (B17 B18 B19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cot
from ..functions import prompts as pr
from ..operators import records as rec
from ..operators.ranking import numeric_block, positions
from ..operators.sampling import exact_split
from ..session import scratch_path, table
from ..sources import records as src
from .evaluation_plans import LANG_CLASSES, lang_class

DATASET = "documents"
IMAGE_FOLDERS = {"train": "/data/images/documents", "test": "/data/images/documents_eval"}
DEFAULT_METHODS = {"train": "default", "test": "accuracy"}
LABEL_METHOD = "toxicity"


def _classes_text(spark: SparkSession) -> DataFrame:
    classes = src.classes_table(spark, [name for _, name in LANG_CLASSES])
    return pr.class_list_text(classes)


def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 6 (B1 B2 D1): SFT records of the labelled documents, flattened columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ct = _classes_text(spark)  # exactly one row
    base = docs.join(labels, on="doc_id", how="inner").crossJoin(F.broadcast(ct))
    msgs = pr.sft_messages(pr.class_prompt("classes_text", "sft"), lang_class("lang"))
    image = F.concat(F.lit(DATASET + "/"), pr.image_file_name("doc_id"))
    return base.select("doc_id", "quality", msgs.alias("m"), image.alias("image")).select(
        "doc_id", "quality",
        F.col("m")[0]["content"].alias("user_content"),
        F.col("m")[1]["content"].alias("assistant_content"), "image")


def _rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    split = exact_split(docs, "doc_id", 0.1, 42).withColumn(
        "split", F.when(F.col("split") == "validation", F.lit("test")).otherwise(F.lit("train")))
    idx = positions(split, ["split"], ["doc_id"], numeric_block("doc_id", 1 << 16), "pos",
                    levels=2)
    ct = _classes_text(spark)
    rows = idx.join(labels, on="doc_id", how="left").crossJoin(F.broadcast(ct))
    i = F.col("pos") - 1
    return rows.select(
        "split",
        F.concat_ws("-", F.lit(DATASET), F.col("split"), i.cast("string")).alias("id"),
        F.concat(F.col("split"), F.lit("/"),
                 F.format_string("%s_%05d.png", F.col("split"), i)).alias("image"),
        pr.rl_conversations(pr.class_prompt("classes_text", "rl"), lang_class("lang"))
        .alias("conversations"),
        F.when(F.col("toxic") == 1, F.lit(LABEL_METHOD)).alias("accu_reward_method"))


def rl_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 6 (B3 A7 → A5 B4-B9 D7 H1): write RL JSONL per split to the shared checkpoint
    folder, read both splits back zipped with their folders and default methods."""
    path = scratch_path(spark, "rl-jsonl")
    src.write_rl_jsonl(_rl_rows(spark, sf_dir), path)
    splits = ["train", "test"]
    ex = src.read_rl_jsonl(spark, [f"{path}/split={s}" for s in splits],
                           [IMAGE_FOLDERS[s] for s in splits],
                           [DEFAULT_METHODS[s] for s in splits], DATASET,
                           template=pr.question_template("rec"))
    return ex.select(
        "id", F.array_join("image_path", ",").alias("image_path"), "problem", "solution",
        "accu_reward_method", "dataset_name",
        F.col("prompt")[0]["content"][F.size(F.col("prompt")[0]["content"]) - 1]["text"]
        .alias("prompt_text"),
        F.size(F.col("prompt")[0]["content"]).alias("prompt_items"))


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 7 (B20): one flattened prompt per conversation."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rec.flatten_conversations(conv)


def _cot_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tagged response per user turn: the assistant turns up to the next user turn are its
    thoughts, the last of them is also the answer. All turns are read; a conversation is bounded
    by the model's context."""
    conv = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    parts = conv.withColumn("part", F.count_if(F.col("role") == "user").over(upto)).groupBy(
        "conv_id", "part").agg(
        F.min(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct(
            "turn", "role", "text")))).alias("said"))
    answer = F.when(F.size("said") > 0, F.element_at("said", -1)["text"])
    thoughts = F.array_join(F.transform("said", lambda m: F.concat(
        F.lit("<think>"), m["text"], F.lit("</think>"))), "")
    raw = parts.select("conv_id", "part", "question", answer.alias("answer"),
                       thoughts.alias("thoughts"))
    response = F.concat(
        F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit(" Answer: "), "thoughts",
        F.lit("<answer>Answer: "), F.coalesce("answer", F.lit("")), F.lit("</answer>"))
    return raw.select("conv_id", "part", "question", "answer", response.alias("response"),
                      F.length("question").alias("width"), F.length("answer").alias("height"))


def cot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 7 (B17 B18 B19): parsed problem/solution of the tagged responses of all turns, kept
    by the filters, with a fingerprint of the rewriting request prompt."""
    raw = _cot_raw(spark, sf_dir)
    parsed = raw.select(
        "conv_id", "part", "width", "height",
        cot.cot_problem("response").alias("problem"),
        cot.cot_solution("response").alias("solution"),
        F.md5(pr.cot_request_prompt(F.coalesce("question", F.lit("")),
                                    F.coalesce("answer", F.lit("")))).alias("request_md5"))
    kept = parsed.filter(cot.cot_keep("problem", "solution", "height", "width"))
    return kept.select("conv_id", "part", "problem", "solution", "request_md5")
