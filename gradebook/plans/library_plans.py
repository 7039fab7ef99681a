"""Plans for the operators that no other plan reaches.

``lineitem`` rows are detections, keypoint sets and boxes, ``part`` rows are models and images,
``documents`` and ``conversations`` are prompts, ``embeddings`` are patches and logits.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, prompts as pr
from ..functions.rewards import RewardFn, register_reward, select_reward
from ..functions.vision import tile_boxes
from ..operators import detection as det
from ..operators import evaluation as ev
from ..operators import guarded as guard
from ..operators import grpo, probe
from ..operators import records as rec
from ..operators import sampling as sm
from ..session import scratch_path, table
from ..sources import documents as doc
from ..sources import records as src
from ..sources import results as res
from .boxes_plans import box_answers, tile_plans
from .detection_plans import _lines, detections
from .rollup_plans import checkpoint_curve

ROUND = 9
BATCH = 16
WANTED = [7, 3, 3, 0, 199]
BASE_SOURCE = "src0"


def detection_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows ``[image, x, y, w, h, score, class]`` become detections with ids
    in input order (here: the order of the line ids)."""
    d = detections(spark, sf_dir)
    b = F.col("bbox")
    matrix = d.select("image_id", b[0].alias("x"), b[1].alias("y"), b[2].alias("w"),
                      b[3].alias("h"), "score", "category_id", F.col("id").alias("place"))
    dts = det.detections_from_matrix(
        matrix, ["image_id", "x", "y", "w", "h", "score", "category_id"], keep=["place"])
    images = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("id"))
    out = det.load_detections(dts, images.distinct(), "place")
    return out.select("image_id", "category_id", "id", F.round("score", ROUND).alias("score"),
                      F.round("area", ROUND).alias("area"), "iscrowd")


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as categories, by brand (name), type (supercategory) and nothing else."""
    cats = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"),
        F.col("p_type").alias("supercategory"))
    return det.filter_categories(cats, names=["Brand#2", "Brand#3", "Brand#17"],
                                 supercategories=["ECONOMY", "SMALL"])


def keypoint_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of 17 shifted keypoints per line; lines with flag ``A`` have no visible
    keypoint."""
    li = _lines(spark, sf_dir)
    ids = range(len(det.KPT_OKS_SIGMAS))
    x = F.col("l_linenumber") * 12.0
    y = F.col("l_quantity")
    seen = lambda i: F.when(F.col("l_returnflag") == "A", 0.0).otherwise(
        ((F.col("l_suppkey") + i) % 3).cast("double"))
    gt = F.array(*[v for i in ids for v in (x + 3.0 * i, y + 2.0 * i, seen(i))])
    dt = F.array(*[v for i in ids for v in (
        x + 3.0 * i + F.col("l_discount") * 20.0, y + 2.0 * i + F.col("l_tax") * 30.0,
        F.lit(1.0))])
    box = F.array(x, y, F.lit(6.0), F.lit(4.0))
    rows = li.select("id", gt.alias("gt"), dt.alias("dt"), box.alias("box"))
    oks = det.keypoint_similarity(F.col("dt"), F.col("gt"), F.col("box"), F.lit(24.0))
    return rows.select("id", F.round(oks, ROUND).alias("oks"))


def gathered_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three listed items of each embedding, in the order of the list."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    idx = F.array((F.col("vec_id") % 64).cast("int"), F.lit(3), F.lit(0))
    kept = e.select("vec_id", probe.gather_by_index(F.col("embedding"), idx).alias("kept"))
    return kept.select("vec_id", *[F.col("kept")[i].cast("double").alias(f"item_{i}")
                                   for i in range(3)])


def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label row three times."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return probe.repeat_rows(labels, 3)


def _text_sizes(texts: list[str]) -> list[str]:
    return [str(len(t)) for t in texts]


def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor over batches of documents; an empty text spoils its whole batch."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 97 == 0, "").otherwise(F.col("text")).alias("prompt"),
        F.floor(F.col("doc_id") / BATCH).cast("long").alias("batch"))
    out = probe.batch_predict(docs, _text_sizes)
    return out.select("doc_id", "batch", "generated_text")


def _word_share(texts: list[str]) -> list[float]:
    return [t.count(" ") / max(len(t), 1) for t in texts]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer (share of spaces) over every turn with its role as the prompt."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("completion"))
    out = probe.model_scores(turns, _word_share)
    return out.select("conv_id", "turn", F.round("reward", ROUND).alias("reward"))


def box_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the format reward that the registry selects for both model families."""
    a = box_answers(spark, sf_dir)
    fns = {f: select_reward("format", "rec", customised=True, family=f) for f in "AB"}
    return a.groupBy("l_returnflag").agg(*[
        F.sum(fns[f]("content")).alias(f"format_{f.lower()}") for f in "AB"])


def next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the token that the score at each position belongs to (events of a user)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return grpo.next_token_alignment(events, "user_id", "event_id", "event_type")


def token_log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: log-softmax of each embedding (as logits) at its label."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), "label")
    score = grpo.log_softmax_at(F.col("logits"), F.col("label"))
    return e.select("vec_id", F.round(score, ROUND).alias("log_probability"))


def _turn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).alias("n")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.floor(F.col("conv_id") / 8).cast("long").alias("batch"),
        F.col("ts.n").alias("ids"))


def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn sizes of each conversation, padded to the longest of its batch of eight
    conversations, on the left and on the right."""
    both = grpo.pad_sequences(_turn_sizes(spark, sf_dir), "ids", "batch", -1, "left", "on_left")
    both = grpo.pad_sequences(both, "ids", "batch", -1, "right", "on_right")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return both.select("conv_id", text("on_left"), text("on_right"))


def clipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 documents with at most 16 words (both caps are the feature)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", " ", -1).alias("tokens"))
    out = grpo.clip_rows(docs, "doc_id", max_samples=100, tokens="tokens", cutoff_len=16)
    return out.select("doc_id", F.array_join("tokens", " ").alias("text"))


def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluator and trainer model families of names made from parts."""
    kind = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == 0, F.concat(F.lit("org/Qwen2-VL-"), size, F.lit("B")))
        .when(kind == 1, F.concat(F.lit("org/qwen-next-"), size))
        .otherwise(F.concat(F.lit("InternVL-qwen2vl-"), size)).alias("model_id"),
        F.when(kind == 1, "qwen2_5_vl").otherwise("other").alias("model_type"),
        (F.col("p_size") > 5).alias("instruct"))
    return p.select("p_partkey", "model_id",
                    names.model_family("model_id", "model_type", "instruct").alias("family"),
                    names.vlm_module("model_id").alias("module"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a plain chat prompt, as a chat message and as a completion."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    m = c.select("conv_id", "turn", pr.chat_message("text", plain=True).alias("plain"),
                 pr.chat_message("text")[0].alias("message"),
                 pr.assistant_wrap("text")[0].alias("completion"))
    return m.select("conv_id", "turn", F.md5("plain").alias("plain_md5"),
                    F.col("message.role").alias("message_role"),
                    F.array_join("message.content.type", ",").alias("message_items"),
                    F.md5(F.element_at("message.content", -1)["text"]).alias("message_md5"),
                    F.col("completion.role").alias("completion_role"),
                    F.md5("completion.content").alias("completion_md5"))


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tile of every part image, the thumbnail last."""
    t = tile_plans(spark, sf_dir).select(
        "p_partkey", F.posexplode(tile_boxes("cols", "rows")).alias("tile", "b"))
    return t.select("p_partkey", "tile", "b.x1", "b.y1", "b.x2", "b.y2", "b.thumbnail")


def rows_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a list of ids, a repeated id twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return rec.load_by_ids(docs, WANTED, "doc_id", spark).select("doc_id", "lang", "n_chars")


def forgetting_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as models, languages as data sets, the share of good documents as accuracy,
    next to the accuracy of the base source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scores = docs.join(labels, "doc_id").groupBy("source", "lang").agg(
        F.round(F.avg("quality") * 100.0, 2).alias("accuracy_percent"))
    out = ev.forgetting_report(scores, "source", "lang", BASE_SOURCE)
    return out.select("source", "lang", "accuracy_percent", "baseline_accuracy",
                      F.round("accuracy_change", 2).alias("accuracy_change"))


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the distinct sources in order."""
    return sm.distinct_sorted(table(spark, sf_dir, "documents"), "source")


def registered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT records are written as JSON lines, registered with the tag names of
    another chat form and read back through the registry."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "registered")
    src.write_sft_json(docs.select(
        pr.sft_messages(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
        .alias("messages"),
        F.array(pr.image_file_name("doc_id")).alias("images")), f"{path}/sft.jsonl")
    registry = {"docs": {"file_name": "sft.jsonl", "formatting": "sharegpt",
                         "columns": {"messages": "messages", "images": "images"},
                         "tags": {"role_tag": "role", "content_tag": "content",
                                  "user_tag": "user", "assistant_tag": "assistant"}}}
    out = rec.read_registered(spark, registry, "docs", path)
    return out.select(F.col("images")[0].alias("image"),
                      F.array_join("messages.role", ",").alias("roles"),
                      F.md5(F.col("messages")[0]["content"]).alias("user_md5"),
                      F.col("messages")[1]["content"].alias("assistant_text"))


REGISTRY = {
    "pairs": {"folder": "pairs", "split": "train", "ranking": True, "formatting": "sharegpt",
              "columns": {"messages": "conversations", "chosen": "chosen",
                          "rejected": "rejected"},
              "tags": {"role_tag": "from", "content_tag": "value", "user_tag": "human",
                       "assistant_tag": "gpt"}},
    "marked": {"folder": "pairs", "subset": "long", "split": "test",
               "columns": {"prompt": "question", "response": "answer", "kto_tag": "label"}},
    "plain": {"folder": "pairs", "columns": {"prompt": "question", "response": "answer"}},
}


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one registered table, split and subset stored as partitions,
    read as comparisons (``ranking``), as marked answers (``kto_tag``) and plainly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where(
        "doc_id is not null")
    said = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    question = F.concat(F.lit("q"), F.col("doc_id"))
    path = scratch_path(spark, "registry")
    docs.select(
        question.alias("question"), F.col("text").alias("answer"),
        F.array(said("human", question), said("system", F.col("source"))).alias("conversations"),
        said("gpt", F.col("text")).alias("chosen"),
        F.when(F.col("lang") != "en", said("gpt", F.col("lang"))).alias("rejected"),
        F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 2 == 0, "true").otherwise(
            "false")).alias("label"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.when(F.length("text") > 500, "long").otherwise("short").alias("subset"),
    ).write.partitionBy("subset", "split").parquet(f"{path}/pairs")
    pairs = rec.read_registered(spark, REGISTRY, "pairs", path).select(
        F.lit("pairs").alias("entry"), F.col("messages")[0]["content"].alias("prompt"),
        F.concat_ws(",", F.array_join("messages.role", ","), "pair.chosen.role").alias("roles"),
        F.md5("pair.chosen.content").alias("answer_md5"),
        F.col("pair.rejected.content").alias("mark"))
    marked = rec.read_registered(spark, REGISTRY, "marked", path).select(
        F.lit("marked").alias("entry"), "prompt", F.lit("").alias("roles"),
        F.md5("response").alias("answer_md5"), F.col("desirable").cast("string").alias("mark"))
    plain = rec.read_registered(spark, REGISTRY, "plain", path).select(
        F.lit("plain").alias("entry"), "prompt", F.lit("").alias("roles"),
        F.md5("response").alias("answer_md5"), F.lit("").alias("mark"))
    return pairs.unionByName(marked).unionByName(plain)


def content_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of conversations whose turns are strings (odd turns) or lists of an image
    and a text item (even turns)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    items = F.to_json(F.array(
        F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), F.col("text"))))
    plain = F.to_json(F.array("text"))  # a JSON string between brackets
    content = F.when(F.col("role") == "system", F.to_json(F.array(F.struct(
        F.lit("text").alias("type"), F.col("text"))))).when(
        F.col("turn") % 2 == 0, items).otherwise(F.substring(plain, F.lit(2), F.length(plain) - 2))
    turns = conv.select("conv_id", "turn", "role", F.when(
        F.col("text").isNotNull(), F.parse_json(content)).alias("text"))
    return rec.flatten_conversations(turns).select(
        "conv_id", "n_messages", F.md5("system_message").alias("system_md5"),
        F.md5("prompt").alias("prompt_md5"))


def rollup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both roll-up tables of the checkpoint curve, written and read back."""
    curve = checkpoint_curve(spark, sf_dir)
    path = scratch_path(spark, "rollup")
    res.write_curve(curve, path)
    res.write_best(curve, path)
    return reduce(DataFrame.unionByName, [
        res.read_rollup(spark, path, which).select(F.lit(which).alias("file"), "*")
        for which in res.ROLLUP_FILES])


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per data set label with its scalar summary; the language is the truth,
    English is predicted for texts that hold "the", else German. The label is the source, the
    last part of a folder named after it, or the kind of the data set."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    named = docs.withColumn("dataset", names.dataset_label(
        F.when(F.col("doc_id") % 3 == 0, F.col("source")),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/Sets/"), F.upper("source"),
                                                  F.when(F.col("doc_id") % 2 == 0, "/")
                                                  .otherwise("")))
        .otherwise(F.lit(None)), F.lit("ImageFolder")))
    found = named.withColumn(
        "prediction", F.when(F.col("text").contains("the"), "en").otherwise("de"))
    return res.evaluation_summary(found, ["dataset"], gt="lang")


def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's question template of both model families, filled with every question."""
    users = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    tasks = [*pr.TEMPLATES_A, "other"]
    filled = [F.struct(F.lit(family).alias("family"), F.lit(task).alias("task"), F.md5(
        pr.fill_template(pr.question_template(task, family), "text")).alias("prompt_md5"))
        for family in "AB" for task in tasks]
    return users.select("conv_id", "turn", F.inline(F.array(*filled)))


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' image paths that no file stands for; an image file is written for
    every country but the first, and the rows are those that lack theirs."""
    root = scratch_path(spark, "images")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    nations.where("n_nationkey > 0").select(
        F.concat(F.lit("image "), "n_nationkey").alias("value"), "n_nationkey").write.partitionBy(
        "n_nationkey").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"),
        F.col("path").alias("own"))
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("int").alias("n_nationkey"))
    wanted = people.join(files, "n_nationkey", "left").select("c_custkey", F.array(F.coalesce(
        "own", F.concat(F.lit(f"{root}/absent-"), F.col("c_custkey"), F.lit(".png"))))
        .alias("image_path"))
    return rec.missing_paths(wanted, "image_path", root).select("c_custkey", F.regexp_extract(
        F.col("image_path")[0], r"([^/]+)$", 1).alias("file"))


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings saved as a labelled set and read back with its class names."""
    root = scratch_path(spark, "labelled")
    src.save_dataset_dir(table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "label"), f"{root}/mnist/test")
    items, classes = src.read_labelled_set(spark, root, "MNIST")
    return items.join(classes, "label").select("item_id", "label", "name")


def rollout_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended batches of scored completions, each row with its own problem."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = scratch_path(spark, "rollouts")
    for part in range(2):
        src.write_rollout_log(turns.where(F.col("turn") % 2 == part).select(
            "conv_id", "turn", F.md5("text").alias("completion_md5"),
            pr.image_file_name("conv_id").alias("image_path"),
            F.length("text").cast("double").alias("reward")), path)
    return spark.read.parquet(path)


def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 documents (the sample table is the feature)."""
    return res.evaluation_sample(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 100)


@F.pandas_udf(T.DoubleType())
def _names_word(content: pd.Series, solution: pd.Series) -> pd.Series:
    return pd.Series([float(isinstance(c, str) and isinstance(s, str) and s in c)
                      for c, s in zip(content, solution)])


def plugged_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a user's reward (does the text hold the name of its language?) by its name."""
    registry: dict[str, RewardFn] = {}
    register_reward(_names_word, "names_word", registry)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", registry["names_word"]("text", "lang").alias("reward"))


def union_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document whose image is a path, a list of two paths (one of them
    absolute) or absent, and whose reward method is named, an explicit null or absent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".png"))
    kind = F.col("doc_id") % 3
    image = F.when(kind == 0, F.to_json(F.array(name))).when(
        kind == 1, F.to_json(F.array(name, F.lit("/abs/x.png"))))
    one = F.when(kind == 0, F.substring(image, 2, F.length(image) - 2)).otherwise(image)
    method = F.when(F.col("doc_id") % 4 == 0, ', "accu_reward_method": null').when(
        F.col("doc_id") % 4 == 1, ', "accu_reward_method": "iou"').otherwise("")
    turns = F.to_json(F.array(*[F.struct(F.lit(who).alias("from"), v.alias("value")) for who, v in (
        ("human", F.concat(F.lit("<image>"), F.coalesce("text", F.lit("")))), ("gpt", name))]))
    line = F.concat(F.lit('{"id": "'), "doc_id", F.lit('"'), F.when(one.isNull(), "").otherwise(
        F.concat(F.lit(', "image": '), one)), method, F.lit(', "conversations": '), turns, F.lit("}"))
    path = scratch_path(spark, "union-jsonl")
    docs.select(line.alias("value")).write.text(path)
    ex = src.read_rl_jsonl(spark, [path], ["/img"], ["default"], "mixed")
    return ex.select(F.col("id").cast("long").alias("doc_id"),
                     F.array_join("image_path", "|").alias("image_path"),
                     F.md5("problem").alias("problem_md5"), "solution", "accu_reward_method",
                     F.size(F.col("prompt")[0]["content"]).alias("prompt_items"))


#: The sections of the document plan.
SECTIONS = {"images": "id long, file_name string", "categories": "id long, name string",
            "annotations": "id long, image_id long, category_id long, bbox array<double>, "
                           "note string", "licenses": "id long"}


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as annotations, orders as images and brands as categories of one JSON document
    (with braces and quotes inside strings), read back by byte ranges; one section is absent."""
    li, parts = _lines(spark, sf_dir), table(spark, sf_dir, "part")
    note = F.concat(F.lit('],"{ '), "l_returnflag", F.lit(" \\"))
    records = {
        "images": table(spark, sf_dir, "orders").select(F.to_json(F.struct(
            F.col("o_orderkey").alias("id"), F.concat("o_orderkey", F.lit(".jpg")).alias(
                "file_name"))).alias("value")),
        "categories": parts.select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col(
            "p_brand").alias("name"))).alias("value")),
        "annotations": li.select(F.to_json(F.struct(
            "id", (F.col("l_orderkey") + 1).alias("image_id"),
            (F.col("l_partkey") % 3 + 1).alias("category_id"),
            F.array(F.col("l_linenumber") * 12.0, F.col("l_quantity") * 2.0).alias("bbox"),
            note.alias("note"))).alias("value"))}
    path = scratch_path(spark, "one-document")  # parts in the order of their folders, by many tasks
    before = '{"info": {"deep": [{"id": 0}]}'
    for k, (name, of) in enumerate(records.items()):
        spark.range(1).select(F.lit(f'{before}, "{name}": [').alias("value")).write.text(
            f"{path}/{k}-0-name")
        of.select(F.concat("value", F.lit(","))).write.text(f"{path}/{k}-1-records")
        before = "null]"
    spark.range(1).select(F.lit("null]}").alias("value")).write.text(f"{path}/{len(records)}-end")
    found = doc.read_sections(spark, path, SECTIONS)
    cols = {"images": ("file_name", "id"), "categories": ("name", "id"),
            "annotations": ("note", "image_id"), "licenses": (None, "id")}
    out = None
    for name, (text, number) in cols.items():
        part = found[name].select(
            F.lit(name).alias("section"), "id", F.col(text).alias("text") if text else
            F.lit(None).cast("string").alias("text"), F.col(number).alias("of"))
        out = part if out is None else out.unionByName(part)
    return out


def _words_per_letter(pdf: pd.DataFrame) -> pd.Series:
    """A user's stage that fails on some texts: those without words, and those marked."""
    if pdf["text"].isna().any():
        raise TypeError("no text")
    counts = pdf["text"].str.count(" ") + 1
    if (pdf["doc_id"] % 97 == 5).any():
        raise RuntimeError("marked")
    return counts


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: what a user function, a reader and a reward leave of bad records: the error per row
    next to the values of all others."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 89 != 3, F.col("text")).alias("text"))
    words = guard.guarded(docs, _words_per_letter, "long").select(
        F.lit("function").alias("stage"), "doc_id", "value", "error")
    path = scratch_path(spark, "guarded-json")
    line = F.when(F.col("doc_id") % 50 == 7, F.lit("{broken")).when(
        F.col("doc_id") % 50 == 8, F.lit('{"id": "x"}')).otherwise(
        F.to_json(F.struct(F.col("doc_id").alias("id"), F.length("text").alias("size"))))
    docs.select(line.alias("value")).write.text(path)
    read = guard.read_json_guarded(spark, path, "id long, size long").select(
        F.lit("reader").alias("stage"), F.col("value.id").alias("doc_id"),
        F.col("value.size").alias("value"), "error")
    reward = guard.guarded_column(F.length("text").cast("long"), {
        "ValueError: no solution": F.col("text").isNull(),
        "ValueError: too short": F.length("text") < 40})
    scored = docs.select(F.lit("reward").alias("stage"), "doc_id", reward.alias("r")).select(
        "stage", "doc_id", "r.value", "r.error")
    return words.unionByName(read).unionByName(scored)


PLANS = {f.__name__: f for f in (
    detection_load, category_filter, keypoint_similarities, gathered_patches, repeated_blocks,
    batch_predictions, model_scores, box_formats, next_tokens, token_log_probabilities,
    padded_sequences, clipped_rows,
    model_families, chat_messages, crop_boxes, rows_by_id, forgetting_by_dataset,
    distinct_sources, registered_records, labelled_items, rollout_log, evaluation_samples,
    plugged_reward, union_examples, error_rows, document_sections, registry_entries,
    content_prompts, rollup_files, run_summaries, task_prompts, missing_images)}
