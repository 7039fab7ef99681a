"""Error rows instead of failed jobs, and images of either type."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradebook.operators import guarded as guard
from gradebook.sources import records as src


def test_a_bad_record_loses_only_itself(spark):
    def stage(pdf):
        if (pdf["x"] == 3).any():
            raise KeyError("three")
        if (pdf["x"] == 4).any():
            return pd.Series([1, 2])
        return pdf["x"] * 10

    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (2.0, None), (4.0, "c"), (None, "d")],
                               "x double, value string").coalesce(1)
    got = {r.x: (r.value, r.error) for r in guard.guarded(df, stage, "double").collect()}
    assert got == {1.0: (10.0, None), 2.0: (20.0, None), None: (None, None),
                   3.0: (None, "KeyError: 'three'"), 4.0: (None, "ValueError: 2 values for 1 rows")}
    assert guard.guarded(df.limit(0), stage, "double").count() == 0


def test_a_stage_gets_small_batches(spark):
    def stage(pdf):
        # in a wide batch all values are wrong
        return pdf["text"].str.len() + (pdf["text"].str.len().sum() > 3 * guard.BATCH_BYTES)

    text = F.repeat(F.lit("x"), F.when(F.col("id") == 7, guard.BATCH_BYTES * 2).otherwise(20_000))
    df = spark.range(400).select("id", text.alias("text"), F.lit(None).cast("timestamp").alias("t")
                                 ).coalesce(1)
    got = guard.guarded(df, stage, "long")
    assert got.dtypes[2:] == [("t", "timestamp"), ("value", "bigint"), ("error", "string")]
    rows = got.select("id", "value", "error").collect()
    assert sorted(r.id for r in rows) == list(range(400))
    assert all(r.error is None and r.value == (
        guard.BATCH_BYTES * 2 if r.id == 7 else 20_000) for r in rows)


def test_json_lines_with_errors(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="gb-guard-"), "x.json")
    with open(path, "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n{"a": "no"}\n[1]\nnull\n{"b": null}\n{oops\n')
    rows = guard.read_json_guarded(spark, path, "a long, b string").collect()
    good = [(r.value.a, r.value.b) for r in rows if r.error is None]
    assert good == [(1, "x"), (None, None)]
    assert sorted(r.line for r in rows if r.error) == sorted(['{"a": "no"}', "[1]", "null", "{oops"])
    assert all(r.value is None for r in rows if r.error)


def test_guarded_column(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    c = guard.guarded_column(F.lit(6) / F.col("x"), {"no x": F.col("x").isNull(), "zero": F.col("x") == 0})
    assert [tuple(r.c) for r in df.select(c.alias("c")).collect()] == [
        (6.0, None), (None, "zero"), (None, "no x")]


def _read(spark, *lines):
    path = os.path.join(tempfile.mkdtemp(prefix="gb-rl-"), "x.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return src.read_rl_jsonl(spark, [path], ["/img/"], ["m"], "ds")


TURNS = '"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]'


def test_images_keep_their_type(spark):
    ex = {r.id: r for r in _read(
        spark, '{"id": "1", "image": "[x].png", %s, "accu_reward_method": null}' % TURNS, "",
        '{"id": "2", "image": ["a", "/b"], %s}' % TURNS, '{"id": "3", "image": [], %s}' % TURNS,
        '{"id": "4", %s}' % TURNS).collect()}
    assert ex["1"].image_path == ["/img/[x].png"] and ex["1"].accu_reward_method is None
    assert ex["2"].image_path == ["/img/a", "/b"] and ex["2"].accu_reward_method == "m"
    assert ex["3"].image_path == [] and ex["4"].image_path is None


@pytest.mark.parametrize("image", ["3", "null", '{"a": 1}', "[1]", '["a", null]'])
def test_other_image_types_raise(spark, image):
    with pytest.raises(Exception, match="Unsupported image type"):
        _read(spark, '{"id": "1", "image": %s, %s}' % (image, TURNS)).collect()
