"""Record reshaping: conversation flattening (B20), registry column mapping (A11, B21),
run grids and missing runs (D6), positional zips (D7), id-ordered lookups (D8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import IMAGE_TAG


def variant_content(content: Column, image_newline: bool = True) -> Column:
    """The text of a turn whose content is a VARIANT: a string as it is, or a list of
    ``{type, text}`` items, in which an image becomes its placeholder and texts are put end to
    end. Any other content, or an item of another type, raises; an item without text counts as
    empty. A NULL content stays NULL."""
    item = "array<struct<type:string,text:string>>"
    kind = F.schema_of_variant(content)
    items = F.try_variant_get(content, "$", item)
    tag = F.lit(IMAGE_TAG + ("\n" if image_newline else ""))
    bad = F.raise_error(F.concat(F.lit("Unsupported content type: "), kind)).cast("string")
    parts = F.transform(items, lambda x: F.when(x["type"] == "image", tag).when(
        x["type"] == "text", F.coalesce(x["text"], F.lit(""))).otherwise(bad))
    return F.when(content.isNull(), F.lit(None).cast("string")).when(
        kind == "STRING", F.try_variant_get(content, "$", "string")).when(
        items.isNull(), bad).otherwise(F.array_join(parts, ""))


def flatten_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                          role: str = "role", text: str = "text",
                          roles: Sequence[str] = ("user", "assistant"),
                          image_newline: bool = True) -> DataFrame:
    """One prompt per conversation.

    A leading ``system`` turn becomes ``system_message`` and is dropped; the remaining
    turns are assigned roles by **position parity** (not by their role field); an odd
    count gets an empty assistant slot. ``<image>`` placeholders get a newline when
    ``image_newline``. A VARIANT ``text`` may be a string or a list of typed items
    (:func:`variant_content`). Per-turn pieces are computed row-wise; only the final string is
    assembled per conversation (a conversation is bounded by the model's context).
    """
    first = turns.groupBy(conv).agg(F.min_by(F.struct(F.col(turn).alias("t"),
                                                      F.col(role).alias("r"),
                                                      F.col(text).alias("x")),
                                             F.col(turn)).alias("_first"))
    system = F.col("_first.x")
    if dict(turns.dtypes)[text] == "variant":  # a list: the text of its first item
        system = F.coalesce(F.try_variant_get(system, "$[0].text", "string"),
                            F.try_variant_get(system, "$", "string"))
    sys_info = first.select(
        conv,
        F.when(F.col("_first.r") == "system", F.col("_first.t")).alias("_sys_turn"),
        F.when(F.col("_first.r") == "system", system).alias("system_message"))
    body = turns.join(sys_info, on=conv, how="inner").filter(
        F.col("_sys_turn").isNull() | (F.col(turn) != F.col("_sys_turn")))
    content = F.col(text)
    if dict(turns.dtypes)[text] == "variant":
        content = variant_content(content, image_newline)
    elif image_newline:
        content = F.replace(content, F.lit(IMAGE_TAG), F.lit(IMAGE_TAG + "\n"))
    piece = F.struct(F.col(turn).alias("t"), content.alias("x"))
    agg = body.groupBy(conv).agg(
        F.array_sort(F.collect_list(piece)).alias("_msgs"))
    msgs = F.transform(F.col("_msgs"), lambda m, i: F.concat(
        F.when(i % 2 == 0, F.lit(roles[0])).otherwise(F.lit(roles[1])), F.lit(": "), m["x"]))
    n = F.size(F.col("_msgs"))
    rendered = F.when(n % 2 == 1, F.concat(F.array_join(msgs, "\n"),
                                           F.lit(f"\n{roles[1]}: ")))\
        .otherwise(F.array_join(msgs, "\n"))
    out = agg.join(sys_info.select(conv, "system_message"), on=conv, how="right")
    return out.select(conv, "system_message",
                      F.coalesce(n, F.lit(0)).alias("n_messages"),
                      F.coalesce(rendered, F.lit("")).alias("prompt"))


def _turn(tags: Mapping[str, str]):
    """Function of a turn struct: the turn as ``role, content`` with canonical role values."""
    rt, ct = tags.get("role_tag", "from"), tags.get("content_tag", "value")
    roles = {tags.get(f"{r}_tag", own): r for r, own in (
        ("user", "human"), ("assistant", "gpt"), ("observation", "observation"),
        ("function", "function_call"), ("system", "system"))}
    names = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return lambda m: F.when(m.isNotNull(), F.struct(
        F.coalesce(F.element_at(names, m[rt]), m[rt]).alias("role"), m[ct].alias("content")))


def map_columns(df: DataFrame, columns: Mapping[str, str],
                tags: Mapping[str, str] | None = None,
                messages_key: str = "messages") -> DataFrame:
    """Rename source columns to canonical names (``columns`` maps canonical → source,
    as in a registry entry) and, with ``tags``, rename the message struct fields and the
    role values to ``role``/``content`` and ``user``/``assistant``/``system``. Chosen and
    rejected answers that are turns are renamed alike; a NULL turn stays NULL. Listed columns that the data lack are
    left out."""
    out = df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()
                      if src in df.columns])
    if tags is None:
        return out
    turn = _turn(tags)
    for name, kind in out.dtypes:
        if name == messages_key and kind.startswith("array<struct<"):
            out = out.withColumn(name, F.transform(F.col(name), turn))
        elif name in ("chosen", "rejected") and kind.startswith("struct<"):
            out = out.withColumn(name, turn(F.col(name)))
    return out


def preference_pairs(df: DataFrame, chosen: str = "chosen",
                     rejected: str = "rejected") -> DataFrame:
    """B21 ``ranking``: chosen and rejected answers as one struct column ``pair``. A row that
    lacks one of them is no comparison and goes."""
    both = F.col(chosen).isNotNull() & F.col(rejected).isNotNull()
    return df.where(both).withColumn("pair", F.struct(
        F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))).drop(chosen, rejected)


def desirability(df: DataFrame, tag: str = "kto_tag") -> DataFrame:
    """B21 ``kto_tag``: the tag as a boolean column ``desirable`` (true: a wanted answer). Tags
    may be booleans, numbers or their texts; a row without a readable tag goes."""
    flag = F.col(tag).cast("string").try_cast("boolean")
    return df.withColumn("desirable", flag).where("desirable is not null").drop(tag)


#: Columns of an entry that lists none, by ``formatting``.
DEFAULT_COLUMNS = {
    "alpaca": {"prompt": "instruction", "query": "input", "response": "output",
               "system": "system", "history": "history"},
    "sharegpt": {"messages": "conversations", "system": "system", "tools": "tools"},
}


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, by the ending of its name."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".txt"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.option("multiLine", path.endswith(".json")).json(path)


def read_registered(spark: SparkSession, registry: Mapping[str, Mapping], name: str,
                    base_dir: str) -> DataFrame:
    """Read a registry entry's local data and map its columns.

    ``file_name`` names a file or folder of JSON, JSONL, parquet, CSV or text; ``folder`` names
    a folder of parquet tables below ``base_dir``. ``subset`` and ``split`` are values of the
    columns of these names, best stored as partitions, which are pruned before anything is
    read; a table with splits gives ``train`` where the entry names none. ``ranking`` gives pairs
    (:func:`preference_pairs`), a ``kto_tag`` column a flag (:func:`desirability`). Hub and
    script sources are not built (no network); they raise, as does a listed subset or split
    that a table without such a column cannot give.
    """
    entry = registry[name]
    if "file_name" in entry:
        df = _read_files(spark, f"{base_dir.rstrip('/')}/{entry['file_name']}")
    elif "folder" in entry:
        df = spark.read.parquet(f"{base_dir.rstrip('/')}/{entry['folder']}")
    else:
        raise ValueError(f"{name}: only local files are supported")
    for key, default in (("subset", None), ("split", "train")):
        if key in df.columns:
            wanted = entry.get(key, default)
            if wanted is not None:
                df = df.where(F.col(key) == wanted)
        elif key in entry:
            raise ValueError(f"{name}: the data have no column {key}")
    form = entry.get("formatting", "alpaca")
    if form not in DEFAULT_COLUMNS:
        raise ValueError(f"{name}: unknown formatting {form}")
    columns = dict(entry.get("columns") or DEFAULT_COLUMNS[form])
    if entry.get("ranking"):
        columns = {"chosen": "chosen", "rejected": "rejected"} | columns
    out = map_columns(df, columns, entry.get("tags", {}) if form == "sharegpt" else None)
    if entry.get("ranking"):
        out = preference_pairs(out)
    return desirability(out) if "kto_tag" in out.columns else out


def run_grid(datasets: DataFrame, models: DataFrame, first: int, last: int,
             step: int) -> DataFrame:
    """Every (dataset, model, checkpoint step) of a sweep; both ends included.
    Both axis tables are small configuration lists, so the cross product is bounded."""
    grid = F.broadcast(datasets).crossJoin(F.broadcast(models))
    steps = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"),
                       F.lit(step).cast("long"))
    return grid.withColumn("step", F.explode(steps))


def missing_runs(expected: DataFrame, finished: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Expected runs without a result (anti-join)."""
    return expected.join(finished.select(*keys).distinct(), on=list(keys), how="left_anti")


def zip_lists(*arrays: Column) -> Column:
    """Positional zip of configuration lists (``arrays_zip``)."""
    return F.arrays_zip(*arrays)


def load_by_ids(df: DataFrame, ids: Sequence, key: str, spark: SparkSession) -> DataFrame:
    """Rows for the requested ids in request order; duplicates repeat; a missing id
    raises when the result is evaluated."""
    req = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"_pos long, {key} long")
    out = req.join(df.withColumn("_hit", F.lit(True)), on=key, how="left")
    missing = F.raise_error(F.concat(F.lit("missing id "), F.col(key).cast("string")))
    # a filter predicate is always evaluated, so the check cannot be pruned away
    return (out.filter(F.coalesce(F.col("_hit"), missing.cast("boolean")))
            .orderBy("_pos").drop("_pos", "_hit"))


def missing_paths(df: DataFrame, path_col: str, root: str) -> DataFrame:
    """Rows whose (exploded) image path is not among the files under ``root``.

    The listing is a ``binaryFile`` scan restricted to the ``path`` column (file
    contents are never read); the check is an anti-join, so it scales with the number of
    files rather than going through the driver.
    """
    spark = df.sparkSession
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"  # the same file on any file system
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.regexp_replace("path", scheme, "").alias("_p")))
    paths = df.select("*", F.explode(F.col(path_col)).alias("_p")).withColumn(
        "_p", F.regexp_replace("_p", scheme, ""))
    return paths.join(files, on="_p", how="left_anti").drop("_p")


def require_paths(df: DataFrame, path_col: str, root: str) -> DataFrame:
    """D5 as a contract: ``df`` unchanged, but evaluation fails if any path is missing."""
    n_missing = missing_paths(df, path_col, root).agg(F.count(F.lit(1)).alias("_missing"))
    fail = F.raise_error(F.lit("Image paths do not exist")).cast("boolean")
    return (df.crossJoin(F.broadcast(n_missing))  # a one-row count
            .filter(F.when(F.col("_missing") > 0, fail).otherwise(F.lit(True)))
            .drop("_missing"))
