"""Prompt and training-record builders as Column expressions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prompt texts of the evaluator and the data preparation scripts.
QUESTION = "What is the main object in this image? "
CHOOSE = "Choose one word from these options: "
ANSWER_FORM = "Answer in the form: 'The answer is [object name].'"
IMAGE_TAG = "<image>"
ANSWER_PREFIX = "The answer is "
PLAIN_CHAT = "User: {prompt}\nAssistant:"

# Question templates by task (first model family) and the single template
# of the second family.
TEMPLATES_A = {
    "rec": "{Question} First output the thinking process in <think> </think> tags and then "
           "output the final answer in <answer> </answer> tags. Output the final answer in "
           "JSON format.",
    "ic": "{Question} First thinks about the reasoning process in the mind and then provides "
          "the user with the answer. The reasoning process and answer are enclosed within "
          "<think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning "
          "process here </think><answer> json format answer here </answer>",
    "odLength": "First thinks about the reasoning process in the mind and then provides the "
                "user with the answer. The reasoning process and answer are enclosed within "
                "<think> </think> and <answer> </answer> tags, respectively, i.e., <think> "
                "reasoning process here </think><answer> answer here </answer>\n{Question}",
}
TEMPLATE_DEFAULT = "{Question}"
TEMPLATE_B = ("{Question} First output the thinking process in <think> </think> tags and then "
              "output the final answer in <answer> </answer> tags.")

# Image token strings of the second model family.
IMG_START = "<img>"
IMG_END = "</img>"
IMG_CONTEXT = "<IMG_CONTEXT>"

# Fixed value: the request template for chain-of-thought rewriting.
COT_REQUEST = """I will provide you with an image, an original question, and its answer related to the image. Your task is to rewrite the question in such a way that answering it requires step-by-step Chain-of-Thought (CoT) reasoning with numerical or mathematical expressions where applicable. The reasoning process can include expressions like "let me think," "oh, I see," or other natural language thought expressions.

Please make sure your question is to ask for a certain answer with a certain value, do not ask for open-ended answer, and the answer is correct and easy to verify via simple protocol, like "2" or "A".

Please strictly do not include "Answer:" in the question part to avoid confusion and leakage.

Input Format:
Original Question: {original_question}
Original Answer: {original_answer}

Output Format:
Question: [rewrite the question if necessary]
Answer: [answer with reasoning steps, including calculations where applicable]
<think>step-by-step reasoning process</think>
<answer>easy to verify answer</answer>
"""

PROMPT_TYPE = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
]))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_list_text(classes: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """B1 (table form): one row, the class names joined by ``", "`` in label order.

    The class table is tiny (one row per class); the result has exactly one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"),
                                                   F.col(name).alias("n"))))
    return classes.agg(F.array_join(F.transform(ordered, lambda x: x["n"]), ", ")
                       .alias("classes_text"))


def class_prompt(classes_text: Column | str, variant: str = "eval") -> Column:
    """B1: the three prompt variants – ``eval`` (with answer form), ``sft`` (``<image>``
    prefix, no answer form) and ``rl`` (``<image>`` prefix and answer form)."""
    ct = _c(classes_text)
    if variant == "eval":
        return F.concat(F.lit(QUESTION + CHOOSE), ct, F.lit(". " + ANSWER_FORM))
    if variant == "sft":
        return F.concat(F.lit(IMAGE_TAG + QUESTION + CHOOSE), ct, F.lit("."))
    if variant == "rl":
        return F.concat(F.lit(IMAGE_TAG + QUESTION + CHOOSE), ct, F.lit(". " + ANSWER_FORM))
    raise ValueError(f"unknown prompt variant {variant!r}")


def image_file_name(idx: Column | str, prefix: str = "") -> Column:
    """``%05d.png`` (B2) or ``<split>_%05d.png``."""
    return F.format_string(prefix + "%05d.png", _c(idx))


def sft_messages(prompt: Column | str, class_name: Column | str) -> Column:
    """B2: ``[{user, prompt}, {assistant, "The answer is " + class}]``."""
    return F.array(
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"),
                 F.concat(F.lit(ANSWER_PREFIX), _c(class_name)).alias("content")))


def rl_conversations(prompt: Column | str, class_name: Column | str) -> Column:
    """``[{from: human, value: prompt}, {from: gpt, value: class}]``."""
    return F.array(
        F.struct(F.lit("human").alias("from"), _c(prompt).alias("value")),
        F.struct(F.lit("gpt").alias("from"), _c(class_name).alias("value")))


def normalise_image_paths(image: Column | str, folder: str) -> Column:
    """A JSON list or a single path → array of paths joined to ``folder``.

    ``os.path.join`` semantics: an absolute path replaces the folder. NULL stays NULL.
    """
    img = _c(image)
    arr = F.when(F.ltrim(img).startswith("["), F.from_json(img, T.ArrayType(T.StringType()))) \
        .otherwise(F.array(img))
    base = folder.rstrip("/")
    return F.when(img.isNull(), F.lit(None).cast(T.ArrayType(T.StringType()))).otherwise(
        F.transform(arr, lambda x: F.when(x.startswith("/"), x)
                    .otherwise(F.concat(F.lit(base + "/" if base else ""), x))))


def image_paths(image: Column, folder: str) -> Column:
    """B4 of a VARIANT: a path or a list of paths → array of paths joined to ``folder``
    (``os.path.join`` semantics). An absent image is NULL; any other type raises, an explicit
    null included."""
    kind = F.schema_of_variant(image)
    paths = F.when(kind == "STRING", F.array(F.try_variant_get(image, "$", "string"))).when(
        kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(image, "$", "array<string>"))
    base = folder.rstrip("/")
    joined = F.transform(paths, lambda x: F.when(x.startswith("/"), x).otherwise(
        F.concat(F.lit(base + "/" if base else ""), x)))
    return F.when(image.isNull(), F.lit(None).cast("array<string>")).when(
        paths.isNull() | F.exists(paths, lambda x: x.isNull()),
        F.raise_error(F.concat(F.lit("Unsupported image type: "), kind)).cast("array<string>")
    ).otherwise(joined)


def problem_from_conversations(conversations: Column | str) -> Column:
    """First turn's value with every ``<image>`` removed."""
    return F.replace(_c(conversations)[0]["value"], F.lit(IMAGE_TAG), F.lit(""))


def solution_from_conversations(conversations: Column | str) -> Column:
    """Second turn's value as a string."""
    return _c(conversations)[1]["value"].cast("string")


def question_template(task: str | None, family: str = "A") -> str:
    """The template text for a task and model family."""
    if family == "B":
        return TEMPLATE_B
    return TEMPLATES_A.get(task or "", TEMPLATE_DEFAULT)


def fill_template(template: str, question: Column | str) -> Column:
    """``template.format(Question=q)``."""
    return F.replace(F.lit(template), F.lit("{Question}"), _c(question))


def make_prompt(image_path: Column | str, text: Column) -> Column:
    """One user message – one image placeholder per path, then the text."""
    n = F.coalesce(F.size(_c(image_path)), F.lit(0))
    n = F.when(n < 0, F.lit(0)).otherwise(n)
    image_item = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    text_item = F.struct(F.lit("text").alias("type"), text.alias("text"))
    content = F.concat(F.array_repeat(image_item, n), F.array(text_item))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def chat_message(prompt: Column | str, plain: bool = False) -> Column:
    """The evaluator's chat message (image + text), or its plain-text form."""
    if plain:
        return F.replace(F.lit(PLAIN_CHAT), F.lit("{prompt}"), _c(prompt))
    return F.array(F.struct(
        F.lit("user").alias("role"),
        F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("text").alias("type"), _c(prompt).alias("text"))
                ).alias("content")))


def assistant_wrap(completion: Column | str) -> Column:
    """Completion text → ``[{role: assistant, content}]``."""
    return F.array(F.struct(F.lit("assistant").alias("role"), _c(completion).alias("content")))


def cot_request_prompt(question: Column | str, answer: Column | str) -> Column:
    """The fixed rewriting request with the question and answer filled in."""
    filled = F.replace(F.lit(COT_REQUEST), F.lit("{original_question}"), _c(question))
    return F.replace(filled, F.lit("{original_answer}"), _c(answer))


def expand_image_tokens(prompt: Column | str, patches: Column | str,
                        tokens_per_patch: int) -> Column:
    """The k-th ``<image>`` becomes start + context × (tokens × patches[k]) + end.

    Returns NULL when the number of placeholders and of patch counts differ (the
    reference asserts that all patch counts are used up).
    """
    pieces = F.split(_c(prompt), IMAGE_TAG, -1)
    n_tags = F.size(pieces) - 1
    expansions = F.transform(_c(patches), lambda k: F.concat(
        F.lit(IMG_START), F.repeat(F.lit(IMG_CONTEXT), k * F.lit(tokens_per_patch)),
        F.lit(IMG_END)))
    padded = F.concat(expansions, F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, padded, lambda a, b: F.concat(a, b)), "")
    return F.when(n_tags == F.size(_c(patches)), joined)

