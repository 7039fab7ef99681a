"""Readers and writers: result trees, prediction files, RL JSONL, file checks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gradebook.functions import names, prompts
from gradebook.operators import records
from gradebook.operators.evaluation import best_per_experiment
from gradebook.sources import records as rec_src
from gradebook.sources import results as rs


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


@pytest.fixture
def tree():
    base = tempfile.mkdtemp(prefix="gb-tree-")
    hdr = "total_samples,correct_predictions,accuracy_percent\r\n"
    _write(f"{base}/expA/400_steps/400_steps_20250101_000000_accuracy.csv", hdr + "100,90,90.00\r\n")
    _write(f"{base}/expA/800_steps/800_steps_20250102_000000_accuracy.csv", hdr + "100,95,95.00\r\n")
    _write(f"{base}/expA/800_steps/800_steps_20250101_000000_accuracy.csv", hdr + "100,10,10.00\r\n")
    _write(f"{base}/expA/nested/1200_steps/1200_steps_x_accuracy.csv", hdr + "100,95,95.00\r\n")
    _write(f"{base}/expB/5_steps/5_steps_x_accuracy.csv", hdr + "10,3,30.00\r\n")
    _write(f"{base}/expB/notsteps/x_accuracy.csv", hdr + "10,9,90.00\r\n")
    _write(f"{base}/7_steps/7_steps_x_accuracy.csv", hdr + "1,1,100.00\r\n")
    _write(f"{base}/expB/9_steps/readme.txt", "no result")
    return base


def test_scan_result_tree(spark, tree):
    df = rs.scan_result_tree(spark, tree)
    got = sorted((r.exp, r.step, r.accuracy_percent, r.total_samples) for r in df.collect())
    assert got == [("(unknown_exp)", 7, 100.0, 1), ("expA", 400, 90.0, 100),
                   ("expA", 800, 95.0, 100), ("expA", 1200, 95.0, 100), ("expB", 5, 30.0, 10)]
    best = {r.exp: r.step for r in best_per_experiment(df).collect()}
    assert best == {"expA": 800, "expB": 5, "(unknown_exp)": 7}


def test_scan_step_dir(spark, tree):
    df = rs.scan_step_dir(spark, f"{tree}/expA")
    assert [(r.step, r.accuracy) for r in df.collect()] == [(400, 90.0), (800, 95.0)]


def test_tree_with_own_headers_spaces_and_a_bad_file(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="gb-tree-"), "all runs")
    _write(f"{base}/my exp/1_steps/a_accuracy.csv",
           "total_samples,correct_predictions,accuracy_percent\n10,5,50.00\n")
    _write(f"{base}/my exp/2_steps/a_accuracy.csv", "accuracy,total,correct\n70.0,10,7\n")
    _write(f"{base}/a+b/3_steps/a_accuracy.csv", "n,accuracy\n4,25\n")
    _write(f"{base}/a+b/4_steps/a_accuracy.csv", "accuracy\noops\n")
    want = {("my exp", 1, 50.0, 10, 5), ("my exp", 2, 70.0, 10, 7), ("a+b", 3, 25.0, 4, None)}
    for path in (base, f"file://{base}"):
        rows = rs.scan_result_tree(spark, path).drop("csv_path").collect()
        assert {tuple(r) for r in rows} == want
    assert {tuple(r) for r in rs.scan_step_dirs(spark, base).where("exp = 'my exp'").collect()} \
        == {("my exp", 1, 50.0), ("my exp", 2, None)}


def test_written_tree_keeps_experiment_names(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="gb-tree-"), "t")
    df = spark.createDataFrame([("x y=1:2", 5, 4, 1)], "exp string, step long, "
                               "total_samples long, correct_predictions long")
    rs.write_result_tree(df, base)
    assert [(r.exp, r.step, r.accuracy_percent) for r in rs.scan_result_tree(spark, base).collect()] \
        == [("x y=1:2", 5, 25.0)]


def test_empty_tree_is_typed(spark):
    empty = tempfile.mkdtemp(prefix="gb-empty-")
    df = rs.scan_result_tree(spark, empty)
    assert df.count() == 0 and "accuracy_percent" in df.columns
    assert rs.scan_step_dir(spark, empty).count() == 0


def test_accuracy_record_text(spark):
    df = spark.createDataFrame([(8, 1), (0, 0)], "total_samples long, correct_predictions long")
    assert [r.accuracy_percent for r in rs.accuracy_record(df).collect()] == ["12.50", "0.00"]


def test_predictions_round_trip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="gb-pred-"), "p")
    rows = [("cat", "dog", 'line one\nline "two", three')]
    df = spark.createDataFrame(rows, "ground_truth string, prediction string, generated_text string")
    rs.write_predictions(df, path)
    back = [tuple(r) for r in rs.read_predictions(spark, path).collect()]
    assert back == rows


def test_rl_jsonl_read(spark):
    d = tempfile.mkdtemp(prefix="gb-rl-")
    _write(f"{d}/a.jsonl",
           '{"id": "1", "image": "x.png", "conversations": [{"from": "human", "value": "<image>Q<image>"}, {"from": "gpt", "value": 3}]}\n'
           '{"id": "2", "image": ["p.png", "/abs/q.png"], "conversations": [{"from": "human", "value": "R"}, {"from": "gpt", "value": "cat"}], "accu_reward_method": "own"}\n')
    _write(f"{d}/b.jsonl",
           '{"id": "3", "conversations": [{"from": "human", "value": "S"}, {"from": "gpt", "value": "dog"}]}\n')
    ex = rec_src.read_rl_jsonl(spark, [f"{d}/a.jsonl", f"{d}/b.jsonl"], ["/img/a", "/img/b"],
                               ["m1", "m2"], "ds")
    got = {r.id: r for r in ex.collect()}
    assert got["1"].image_path == ["/img/a/x.png"] and got["1"].problem == "Q"
    assert got["1"].solution == "3" and got["1"].accu_reward_method == "m1"
    assert got["2"].image_path == ["/img/a/p.png", "/abs/q.png"]
    assert got["2"].accu_reward_method == "own"
    assert got["3"].image_path is None and got["3"].accu_reward_method == "m2"
    assert [c.type for c in got["2"].prompt[0].content] == ["image", "image", "text"]
    with pytest.raises(ValueError):
        rec_src.read_rl_jsonl(spark, ["a"], [], None, "ds")


def test_missing_paths(spark):
    root = tempfile.mkdtemp(prefix="gb-img-")
    _write(f"{root}/a.png", "x")
    df = spark.createDataFrame([(1, [f"{root}/a.png"]), (2, [f"{root}/b.png"])],
                               "id long, image_path array<string>")
    assert [r.id for r in records.missing_paths(df, "image_path", root).collect()] == [2]
    with pytest.raises(Exception):
        records.require_paths(df, "image_path", root).collect()
    ok = df.filter(F.col("id") == 1)
    assert records.require_paths(ok, "image_path", root).count() == 1


def test_run_grid_and_missing(spark):
    ds = spark.createDataFrame([("cifar10",), ("mnist",)], "dataset string")
    models = spark.createDataFrame([("m1",)], "model string")
    grid = records.run_grid(ds, models, 1000, 3000, 1000)
    assert grid.count() == 6
    done = spark.createDataFrame([("cifar10", "m1", 1000)], "dataset string, model string, step long")
    assert records.missing_runs(grid, done, ["dataset", "model", "step"]).count() == 5


def test_load_by_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    assert [r.v for r in records.load_by_ids(df, [3, 1, 3], "id", spark).collect()] == ["c", "a", "c"]
    with pytest.raises(Exception):
        records.load_by_ids(df, [9], "id", spark).collect()


def test_map_columns_sharegpt(spark):
    df = spark.createDataFrame([([("human", "hi"), ("gpt", "yo")], ["i.png"])],
                               "conversations array<struct<from:string,value:string>>, images array<string>")
    out = records.map_columns(df, {"messages": "conversations", "images": "images"},
                              {"role_tag": "from", "content_tag": "value", "user_tag": "human",
                               "assistant_tag": "gpt"}).collect()[0]
    assert [(m.role, m.content) for m in out.messages] == [("user", "hi"), ("assistant", "yo")]


def test_model_family_and_run_name(spark):
    df = spark.createDataFrame([("Qwen/Qwen2-VL-2B", "qwen2_vl", True),
                                ("x/qwen2_5", "qwen2_5_vl", True), ("any", "t", False)],
                               "m string, t string, i boolean")
    fam = [r.f for r in df.select(names.model_family("m", "t", "i").alias("f")).collect()]
    assert fam == ["qwen_instruct_like", "qwen_instruct_like", "qwen_noninstruct_like"]
    bad = spark.createDataFrame([("llama", "llama", True)], "m string, t string, i boolean")
    with pytest.raises(Exception):
        bad.select(names.model_family("m", "t", "i")).collect()
    ts = spark.createDataFrame([("a/b", "cifar10")], "m string, d string").select(
        names.run_name(None, "m", "d", F.to_timestamp(F.lit("2025-08-13 10:30:37"))).alias("r"))
    assert ts.collect()[0].r == "a_b_cifar10_20250813_103037"


def test_class_prompt_variants(spark):
    cls = rec_src.classes_table(spark, ["b", "a"])
    text = prompts.class_list_text(cls).collect()[0].classes_text
    assert text == "b, a"
    assert rec_src.class_names("CIFAR10")[0] == "airplane" and len(rec_src.class_names("cifar100")) == 100
    with pytest.raises(ValueError):
        rec_src.class_names("imagenet")
