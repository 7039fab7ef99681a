"""Checkpoint result files: readers and writers.

Two layouts are supported:

* the evaluator's tree ``<base>/<exp>/<n>_steps/<n>_steps_<time>_accuracy.csv`` (one
  one-row CSV per checkpoint) – read by :func:`scan_result_tree` / :func:`scan_step_dir`;
* Spark's own partitioned layout ``<base>/exp=<e>/step=<n>/part-*.csv`` – written by
  :func:`write_accuracy` and read by :func:`read_results` with partition pruning.

File listing happens once on the driver (as for any Spark file source); the CSV bodies
are read by the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import parse_experiment, parse_step, parse_step_loose
from ..operators.evaluation import best_per_experiment

RESULT_SCHEMA = T.StructType([
    T.StructField("exp", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("accuracy_percent", T.DoubleType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("correct_predictions", T.LongType()),
    T.StructField("csv_path", T.StringType()),
])

# Candidate column names, first existing one wins.
ACCURACY_COLUMNS = ["accuracy_percent", "accuracy"]
TOTAL_COLUMNS = ["total_samples", "total", "n", "num_samples"]
CORRECT_COLUMNS = ["correct_predictions", "correct", "num_correct"]


def _base_path(spark: SparkSession, base_dir: str) -> tuple[str, bool]:
    """The path part of ``base_dir`` on its file system, and whether it exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toUri().getPath().rstrip("/"), fs.exists(path)


def _accuracy_files(spark: SparkSession, base_dir: str) -> DataFrame:
    """``csv_path, rel`` (below ``base_dir``) and the cells ``names, cells`` of the header and
    the first record of every ``*_accuracy.csv``; each file keeps its own header."""
    base, exists = _base_path(spark, base_dir)
    if not exists:
        return spark.createDataFrame(
            [], "csv_path string, rel string, names array<string>, cells array<string>")
    files = (spark.read.option("pathGlobFilter", "*_accuracy.csv")
             .option("recursiveFileLookup", True).text(base_dir, wholetext=True))
    # file_path is URL-encoded; a plus sign stands for itself there
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    lines = F.filter(F.split("value", r"\r?\n|\r"), lambda line: F.trim(line) != "")

    def cells(at: int) -> Column:
        return F.transform(F.split(F.coalesce(F.get(lines, F.lit(at)), F.lit("")), ","),
                           lambda c: F.regexp_replace(F.trim(c), '^\ufeff?"?|"$', ""))

    return files.select(path.alias("csv_path"), F.substring(path, len(base) + 2, 1 << 30)
                        .alias("rel"), cells(0).alias("names"), cells(1).alias("cells"))


def _cell(candidates: list[str]) -> Column:
    """B16 per file: the cell below the first candidate name that the file's header holds."""
    at = F.coalesce(*[F.nullif(F.array_position("names", c), F.lit(0)) for c in candidates])
    return F.get(F.col("cells"), (at - 1).cast("int"))


def scan_result_tree(spark: SparkSession, base_dir: str) -> DataFrame:
    """A1: walk ``base_dir``; keep files in directories named ``<digits>_steps``.

    exp = first directory under ``base_dir`` (``(unknown_exp)`` when the step directory
    is directly under it); one file per directory (the greatest name = latest run); a file
    without a numeric accuracy is skipped. Returns :data:`RESULT_SCHEMA`; an empty or absent
    tree gives an empty typed DataFrame.
    """
    base, _ = _base_path(spark, base_dir)
    rows = _accuracy_files(spark, base_dir).where(F.col("rel").rlike(r"(^|/)\d+_steps/[^/]*$"))
    one = rows.groupBy(F.regexp_replace("rel", "/[^/]*$", "").alias("dir")).agg(
        F.max_by(F.struct("csv_path", "names", "cells"), "csv_path").alias("r")).select("r.*")
    return one.select(
        parse_experiment("csv_path", base).alias("exp"), parse_step("csv_path").alias("step"),
        _cell(ACCURACY_COLUMNS).try_cast("double").alias("accuracy_percent"),
        _cell(TOTAL_COLUMNS).try_cast("long").alias("total_samples"),
        _cell(CORRECT_COLUMNS).try_cast("long").alias("correct_predictions"),
        "csv_path").where("accuracy_percent is not null")


def scan_step_dirs(spark: SparkSession, base_dir: str) -> DataFrame:
    """A2 for every experiment at once: ``exp, step, accuracy`` of the files
    ``<base>/<exp>/<x>_steps/*_accuracy.csv``."""
    return _step_files(spark, base_dir, 3).select(
        F.col("r.parts")[0].alias("exp"), "r.step", "r.accuracy")


def scan_step_dir(spark: SparkSession, base_dir: str) -> DataFrame:
    """A2: one level only – ``<base>/<x>_steps/*_accuracy.csv`` where ``x`` casts to int.

    Returns ``(step, accuracy)`` ordered by step (G1); ``accuracy_percent`` is mandatory.
    """
    return _step_files(spark, base_dir, 2).select("r.step", "r.accuracy").orderBy("step")


def _step_files(spark: SparkSession, base_dir: str, depth: int) -> DataFrame:
    """The latest file ``r`` of each step directory whose files lie ``depth`` names deep."""
    rows = _accuracy_files(spark, base_dir).withColumn("parts", F.split("rel", "/")).where(
        F.size("parts") == depth).withColumn(
        "step", parse_step_loose(F.element_at("parts", -2))).where("step is not null")
    rows = rows.withColumn("accuracy", _cell(ACCURACY_COLUMNS[:1]).try_cast("double"))
    return rows.groupBy(F.slice("parts", 1, depth - 1).alias("dir")).agg(
        F.max_by(F.struct("parts", "step", "accuracy"), "csv_path").alias("r"))


def accuracy_record(df: DataFrame) -> DataFrame:
    """A3 body: ``total_samples, correct_predictions, accuracy_percent`` as 2-decimal text."""
    acc = F.when(F.col("total_samples") > 0,
                 F.lit(100.0) * F.col("correct_predictions") / F.col("total_samples")
                 ).otherwise(F.lit(0.0))
    keep = [c for c in df.columns if c not in ("total_samples", "correct_predictions",
                                               "accuracy_percent")]
    return df.select(*keep, "total_samples", "correct_predictions",
                     F.format_string("%.2f", acc).alias("accuracy_percent"))


def write_accuracy(df: DataFrame, path: str, partition_by=("exp", "step")) -> None:
    """Write accuracy records as CSV with a header, partitioned by exp/step."""
    (accuracy_record(df).write.mode("overwrite").option("header", True)
     .partitionBy(*partition_by).csv(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Read :func:`write_accuracy` output back (partition columns exp/step discovered)."""
    schema = T.StructType([
        T.StructField("total_samples", T.LongType()),
        T.StructField("correct_predictions", T.LongType()),
        T.StructField("accuracy_percent", T.DoubleType()),
        T.StructField("exp", T.StringType()),
        T.StructField("step", T.LongType()),
    ])
    return spark.read.option("header", True).schema(schema).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """A4: ``ground_truth, prediction, generated_text`` with quoted embedded newlines."""
    (df.select("ground_truth", "prediction", "generated_text").write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read :func:`write_predictions` output back (multi-line records)."""
    schema = "ground_truth string, prediction string, generated_text string"
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema(schema).csv(path))


def evaluation_sample(df: DataFrame, order_key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows in an explicit order (top-n, the feature itself)."""
    return df.orderBy(order_key).limit(n)


def evaluation_summary(samples: DataFrame, by: Sequence[str] = (), gt: str = "ground_truth",
                       pred: str = "prediction") -> DataFrame:
    """``total_examples, total_correct, final_accuracy`` (percent, unrounded; 0 without
    rows) of a run's samples; one row, or one per group of ``by``. A NULL prediction or truth
    is wrong."""
    out = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(F.col(gt) == F.col(pred)).alias("total_correct"))
    return out.withColumn("final_accuracy", F.when(
        F.col("total_examples") > 0,
        F.lit(100.0) * F.col("total_correct") / F.col("total_examples")).otherwise(F.lit(0.0)))


#: The two roll-up tables of a result tree.
ROLLUP_FILES = {"curve": "all_steps_accuracy", "best": "best_accuracy_per_exp"}


def write_curve(results: DataFrame, base_dir: str) -> None:
    """The results of a tree, ordered by exp and step, as CSV under
    ``<base>/all_steps_accuracy``. The order is a range sort, so no task holds all rows."""
    (results.orderBy("exp", "step").write.mode("overwrite").option("header", True)
     .csv(f"{base_dir.rstrip('/')}/{ROLLUP_FILES['curve']}"))


def write_best(results: DataFrame, base_dir: str) -> None:
    """The best checkpoint of every experiment as CSV under
    ``<base>/best_accuracy_per_exp``."""
    best = best_per_experiment(results, extra=[c for c in results.columns if c == "csv_path"])
    (best.orderBy("exp").write.mode("overwrite").option("header", True)
     .csv(f"{base_dir.rstrip('/')}/{ROLLUP_FILES['best']}"))


def read_rollup(spark: SparkSession, base_dir: str, which: str) -> DataFrame:
    """A table of :func:`write_curve` (``curve``) or :func:`write_best` (``best``)."""
    path = f"{base_dir.rstrip('/')}/{ROLLUP_FILES[which]}"
    found = spark.read.option("header", True).csv(path)
    return found.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA
                          if f.name in found.columns])


def write_result_tree(df: DataFrame, base_dir: str, run_stamp: str = "00000000_000000") -> None:
    """A3 in the evaluator's layout: ``<base>/<exp>/<n>_steps/<n>_steps_<stamp>_accuracy.csv``.

    Spark writes one CSV file per (exp, step) partition in parallel; the driver then only
    renames the partition directories and files (metadata operations through the
    Hadoop file system, no data passes through the driver).
    """
    staged = (accuracy_record(df)
              .withColumn("_dir", F.concat(F.col("step").cast("string"), F.lit("_steps")))
              .repartition("exp", "_dir"))
    tmp = base_dir.rstrip("/") + "/_spark_out"
    (staged.drop("step").write.mode("overwrite").option("header", True)
     .partitionBy("exp", "_dir").csv(tmp))
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(tmp)
    fs = root.getFileSystem(conf)
    for exp_status in fs.listStatus(root):
        name = exp_status.getPath().getName()
        if not exp_status.isDirectory() or not name.startswith("exp="):
            continue
        exp = unquote(name[len("exp="):]).replace("/", "%2F")  # no name holds a slash
        for step_status in fs.listStatus(exp_status.getPath()):
            sname = step_status.getPath().getName()
            if not step_status.isDirectory() or not sname.startswith("_dir="):
                continue
            step_dir = sname[len("_dir="):]
            target = jvm.org.apache.hadoop.fs.Path(f"{base_dir.rstrip('/')}/{exp}/{step_dir}")
            fs.mkdirs(target)
            parts = [s.getPath() for s in fs.listStatus(step_status.getPath())
                     if s.getPath().getName().startswith("part-")]
            for i, part in enumerate(sorted(parts, key=lambda p: p.getName())):
                suffix = "" if i == 0 else f"_{i}"
                fs.rename(part, jvm.org.apache.hadoop.fs.Path(
                    target, f"{step_dir}_{run_stamp}{suffix}_accuracy.csv"))
    # the emptied staging folder starts with "_", so file sources skip it
