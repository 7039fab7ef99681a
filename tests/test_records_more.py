"""Registry entries, typed content, roll-up files and run labels on small fixtures."""

import pytest
from pyspark.sql import functions as F

from gradebook.functions import names
from gradebook.operators import records as rec
from gradebook.sources import results as res


def _content(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.c for r in df.select(rec.variant_content(F.parse_json("t")).alias("c")).collect()]


def test_content_is_a_string_or_a_list(spark):
    got = _content(spark, ['"a <image>"', None, "[]", '[{"type":"image"},{"type":"text"},'
                           '{"type":"text","text":"b"}]'])
    assert got == ["a <image>", None, "", "<image>\nb"]


@pytest.mark.parametrize("text", ["5", '{"type":"text"}', '[{"type":"video"}]', "null"])
def test_other_content_raises(spark, text):
    with pytest.raises(Exception, match="Unsupported content type"):
        _content(spark, [text])


def test_ranking_and_marks(spark, tmp_path):
    turn = "struct<`from`:string,value:string>"
    spark.createDataFrame(
        [([("human", "q")], ("gpt", "good"), ("gpt", "bad"), "1", "train"),
         ([("human", "q"), None], ("gpt", "good"), None, "no", "train"),
         (None, None, None, "?", "test")],
        f"conversations array<{turn}>, chosen {turn}, rejected {turn}, label string, split string"
    ).write.parquet(f"{tmp_path}/t")
    registry = {
        "rank": {"folder": "t", "ranking": True, "formatting": "sharegpt"},
        "kto": {"folder": "t", "formatting": "sharegpt",
                "columns": {"messages": "conversations", "kto_tag": "label"}},
        "test": {"folder": "t", "split": "test", "columns": {"response": "label"}},
        "subset": {"folder": "t", "subset": "x"}, "hub": {"hf_hub_url": "a/b"},
        "form": {"folder": "t", "formatting": "other"}}
    read = lambda name: rec.read_registered(spark, registry, name, str(tmp_path))
    pair = read("rank").collect()
    assert [(r.pair.chosen.role, r.pair.rejected.content) for r in pair] == [("assistant", "bad")]
    kto = {len(r.messages): (r.messages[-1] and r.messages[-1].role, r.desirable)
           for r in read("kto").collect()}
    assert kto == {1: ("user", True), 2: (None, False)}
    assert [r.response for r in read("test").collect()] == ["?"]
    for name in ("subset", "hub", "form"):
        with pytest.raises(ValueError):
            read(name)


def test_dataset_label(spark):
    df = spark.createDataFrame(
        [("Own", "/x/Y", "K"), (None, "/x/Y", "K"), ("", "/x/Y/", "K"), (None, None, "K"),
         (None, "Z", "K")], "name string, root string, kind string")
    got = [r[0] for r in df.select(names.dataset_label("name", "root", "kind")).collect()]
    assert got == ["Own", "y", "k", "k", "z"]


def test_summary_of_no_rows_and_nulls(spark):
    kind = "ground_truth string, prediction string"
    none = spark.createDataFrame([], kind)
    assert tuple(res.evaluation_summary(none).first()) == (0, 0, 0.0)
    some = spark.createDataFrame([("a", "a"), ("a", None), (None, None)], kind)
    row = res.evaluation_summary(some).first()
    assert (row.total_examples, row.total_correct) == (3, 1)
    assert abs(row.final_accuracy - 100 / 3) < 1e-9


def test_rollup_files(spark, tmp_path):
    rows = [("a", 2, 50.0, 4, 2, "p"), ("a", 1, 50.0, None, 2, "q"), ("b", 1, 1.0, 1, None, None)]
    for data, best in ((rows, [("a", 1, 50.0, 4, 2, "q"), ("b", 1, 1.0, 1, None, None)]),
                       ([], [])):
        df = spark.createDataFrame(data, res.RESULT_SCHEMA)
        res.write_curve(df, str(tmp_path))
        res.write_best(df, str(tmp_path))
        curve = res.read_rollup(spark, str(tmp_path), "curve")
        assert sorted(map(str, map(tuple, curve.collect()))) == sorted(map(str, data))
        found = res.read_rollup(spark, str(tmp_path), "best").select(*res.RESULT_SCHEMA.names
                                                                     if data else "*")
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, best))
