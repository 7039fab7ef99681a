"""Hand-made edge cases (FIXTURES.md §3) and plain-Python restatements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gradebook.functions import cot, names, prompts, rewards, text, vision
from gradebook.functions.math_answer import grade_math, last_boxed, normalised
from gradebook.operators import evaluation as ev
from gradebook.operators import grpo, records, sampling


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("x")).collect()


# ---- C1 -------------------------------------------------------------------------------

@pytest.mark.parametrize("classes,text_,expected", [
    (["cat", "dog"], "A dog, then a cat", "dog"),
    (["apple", "apple tree"], "apple tree", "apple"),
    (["apple tree", "apple"], "apple tree", "apple tree"),
    (["maple_tree"], "maple tree", "unknown"),
    (["cat"], "écat", "unknown"),
    (["cat"], "", "unknown"),
    (["Cat"], "  THE CAT.\n", "cat"),
])
def test_first_mentioned_class(spark, classes, text_, expected):
    rows = one(spark, text.first_mentioned_class("t", classes), [(text_,)], "t string")
    assert rows[0]["x"] == expected


def _python_c1(t, classes):
    low = t.strip().lower()
    found, best = "unknown", float("inf")
    for c in classes:
        m = re.search(r"\b" + re.escape(c.lower()) + r"\b", low)
        if m and m.start() < best:
            best, found = m.start(), c.lower()
    return found


def test_first_mentioned_class_random(spark):
    rng = random.Random(7)
    classes = ["an", "ant", "an t", "é", "café", "b_c", "b", "x1", "tree", "apple tree", "apple"]
    alphabet = ["an", "t", " ", "é", "café", "b", "_", "c", "x", "1", "\n", ",", "apple", "tree"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select(text.first_mentioned_class("t", classes).alias("x")).collect()]
    want = [_python_c1(t, classes) for t in texts]
    assert got == want


# ---- E1, E11, E12, E14 ----------------------------------------------------------------

def test_accuracy_error_rows(spark):
    df = spark.createDataFrame([("cat", "cat"), ("cat", "unknown"),
                                ("cat", text.MODEL_ERROR)], "ground_truth string, prediction string")
    r = ev.accuracy(df, []).collect()[0]
    assert (r.total_samples, r.correct_predictions, r.accuracy_percent) == (2, 1, 50.0)


def test_accuracy_no_valid_rows(spark):
    df = spark.createDataFrame([("cat", text.MODEL_ERROR)], "ground_truth string, prediction string")
    r = ev.accuracy(df, []).collect()[0]
    assert (r.total_samples, r.accuracy_percent) == (0, 0.0)


def test_best_per_experiment_tie_and_null(spark):
    df = spark.createDataFrame(
        [("e", 400, 90.0, None, 5), ("e", 800, 90.0, 7, 6), ("e", 100, 50.0, 1, 1)],
        "exp string, step long, accuracy_percent double, total_samples long, "
        "correct_predictions long")
    r = ev.best_per_experiment(df).collect()[0]
    assert (r.step, r.accuracy_percent, r.total_samples, r.correct_predictions) == (400, 90.0, 7, 5)


def test_best_epoch_strict(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.7), (3, 0.7), (4, 0.5)],
                               "epoch int, val_accuracy double")
    r = ev.best_epoch(df).collect()[0]
    assert (r.best_epoch, r.best_accuracy) == (2, 0.7)


def test_running_accuracy_matches_cumsum(spark):
    rng = random.Random(3)
    data = [(k, i, "a", rng.choice(["a", "b", text.MODEL_ERROR]))
            for k in ("s1", "s2") for i in rng.sample(range(100000), 300)]
    df = spark.createDataFrame(data, "source string, seq long, ground_truth string, "
                                     "prediction string")
    out = {(r.source, r.seq): (r.position, r.running_total, r.running_correct)
           for r in ev.running_accuracy(df, ["source"], "seq", block_width=1000).collect()}
    for k in ("s1", "s2"):
        rows = sorted((s, p) for kk, s, _, p in data if kk == k)
        tot = cor = 0
        for pos, (s, p) in enumerate(rows, start=1):
            tot += p != text.MODEL_ERROR
            cor += p == "a"
            assert out[(k, s)] == (pos, tot, cor)


# ---- C2 C3 C5 C6 ----------------------------------------------------------------------

def test_classification_reward_case(spark):
    rows = one(spark, rewards.classification_reward("t", "s", ["cat"]), [("cat", "Cat")],
               "t string, s string")
    assert rows[0]["x"] == 0.0


@pytest.mark.parametrize("s,expected", [("the answer is maple_tree", 1.0),
                                        ("The answer is a b.", 0.0),
                                        ("  The answer is Dog.\n", 1.0)])
def test_format_reward(spark, s, expected):
    assert one(spark, text.format_reward("t"), [(s,)], "t string")[0]["x"] == expected


def test_box_iou_xyxy(spark):
    df = spark.createDataFrame([([0, 0, 10, 10], [0, 0, 10, 10]),
                                ([0, 0, 10, 10], [9, 9, 20, 20])], "a array<int>, b array<int>")
    got = [r.x for r in df.select(rewards.box_iou_xyxy(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [1.0, 0.0]


def test_iou_reward_forms(spark):
    data = [("<think>x</think><answer>[0,0,10,10]</answer>", "<answer>[0,0,10,10]</answer>"),
            ("no answer here", "<answer>[0,0,10,10]</answer>"),
            ("<answer>{\"b\": [0, 0, 5, 10]}</answer>", "<answer>x</answer><answer>[0,0,10,10]</answer>")]
    df = spark.createDataFrame(data, "c string, s string")
    col_form = [r.x for r in df.select(rewards.iou_reward("c", "s").alias("x")).collect()]
    staged = [r.x for r in rewards.with_iou_reward(df, "c", "s", "x").collect()]
    assert col_form == staged == [1.0, 0.0, 0.5]


def test_format_reward_rec(spark):
    s = "<think>a</think> <answer>{\"bbox\": [1, 2, 3, 4]}</answer>"
    b = "<think>a</think><answer>[1,2,3,4]</answer>"
    df = spark.createDataFrame([(s,), (b,)], "t string")
    a_ = [r.x for r in df.select(text.format_reward_rec("t", True).alias("x")).collect()]
    b_ = [r.x for r in df.select(text.format_reward_rec("t", False).alias("x")).collect()]
    assert a_ == [1.0, 0.0] and b_ == [1.0, 1.0]


# ---- C7-C9 ----------------------------------------------------------------------------

def test_normalised_forms(spark):
    half = "\\frac{1}{2}"
    want = {"0.5": half, "\\frac12": half, "1/2": half, "\\dfrac{1}{2}": half, ".5": half,
            "x=1/2": half, "k = 0.5": half, "\\frac1{2}": half, "abc=2": "abc=2", "": "",
            "x=": "", "5\\text{ cm}": "5", "5\\text{ a}\\text{ b}": None, "\\sqrt3": "\\sqrt{3}",
            "\\sqrt": None, "\\sqrt\\sqrt2": None, "\\frac": None, "\\frac1": "\\frac1",
            "\\frac1\\frac": "\\frac1\\frac", "\\frac\\frac1": None, "50\\%": "50", "\\$3": "3",
            "90^\\circ": "90", "a/b": None, "1/2/3": "1/2/3", "-3/4": "\\frac{-3}{4}",
            "01/2": "01/2", "-0/2": "-0/2", "1 / 2": half, "1_0/2": "1_0/2"}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: r.x for r in df.select("s", normalised(F.col("s")).alias("x")).collect()}
    assert got == want


def test_last_boxed(spark):
    want = {"a \\boxed{1} \\boxed{2{3}}4": "\\boxed{2{3}}", "\\boxed{1": None, "none": None,
            "\\boxed 3$ \\boxed{4}": "\\boxed 3", "\\fbox{5}": "\\fbox{5}",
            "\\fbox{5} \\boxed{6}": "\\boxed{6}", "\\boxed}{7}": None, "\\boxed": None,
            "\\boxed{" + "{x}" * 2000 + "} y": "\\boxed{" + "{x}" * 2000 + "}"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "s string")
    got = {r.s: r.x for r in df.select("s", last_boxed(F.col("s")).alias("x")).collect()}
    assert got == want | {None: None}


def test_grade_cases(spark):
    cases = [("The answer is $\\boxed{\\frac{1}{2}}$", "0.5", 1.0),
             ("\\boxed 3/4$", "\\frac34", 1.0),
             ("\\fbox{3}", "3", 0.0),  # not unboxable → 0
             ("1.5/2", "1.5/2", 1.0),  # identical strings
             # "1.5/2" has no written form, so the raw strings are compared: not equal
             ("x = 1.5/2", "1.5/2", 0.0),
             ("\\boxed{1.5/2}", "1.5/2", 1.0), ("\\boxedx{3}", "3", 0.0),
             ("\\boxed{3", "3", 0.0), ("\\boxed{1}\\boxed{2}", "2", 1.0),
             (None, None, 1.0), (None, "1", 0.0), ("1", None, 0.0), ("", "", 1.0)]
    df = spark.createDataFrame(cases, "a string, t string, want double")
    for r in df.select("*", grade_math(F.col("a"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


# ---- E3 F6 F7 E5 E6 --------------------------------------------------------------------

def test_advantages(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 0.0), ("p", 0.0), ("p", 1.0), ("q", 1.0),
                                ("r", 1.0), ("r", 1.0)], "prompt_id string, reward double")
    out = {(r.prompt_id, r.reward): r for r in grpo.advantages(df, "prompt_id").collect()}
    p = out[("p", 1.0)]
    assert p.group_mean == 0.5 and abs(p.group_std - 0.57735) < 1e-5
    assert abs(p.advantage - 0.86588) < 1e-5 and abs(out[("p", 0.0)].advantage + 0.86588) < 1e-5
    assert out[("q", 1.0)].advantage is None
    assert out[("r", 1.0)].advantage == 0.0


def test_completion_mask(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 2, 9, 2])] +
                                 [(2, i, t) for i, t in enumerate([5, 9])],
                                 "row_id long, pos int, token long")
    got = {(r.row_id, r.pos): r.mask for r in
           grpo.completion_mask(toks, "row_id", "pos", "token", 2).collect()}
    assert [got[(1, i)] for i in range(4)] == [1, 1, 0, 0]
    assert [got[(2, i)] for i in range(2)] == [1, 1]
    arr = spark.createDataFrame([([5, 2, 9, 2],), ([5, 9],)], "ids array<long>")
    assert [r.m for r in arr.select(grpo.mask_array(F.col("ids"), 2).alias("m")).collect()] == \
        [[1, 1, 0, 0], [1, 1]]


def test_loss_summary_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = []
    for r in range(5):
        adv = float(rng.normal())
        for p in range(7):
            lp, old, ref = rng.normal(size=3) * 0.3 - 1
            rows.append((r, p, float(lp), float(old), float(ref), adv, int(p < 5)))
    df = spark.createDataFrame(rows, "row_id long, pos int, lp double, old_lp double, "
                                     "ref_lp double, advantage double, mask int")
    s = grpo.loss_summary(grpo.row_means(grpo.token_loss_terms(df), "row_id")).collect()[0]
    a = np.array(rows, dtype=float)
    lp, old, ref, adv, mask = a[:, 2], a[:, 3], a[:, 4], a[:, 5], a[:, 6]
    d = ref - lp
    kl = np.exp(d) - d - 1
    ratio = np.exp(lp - old)
    l1, l2 = ratio * adv, np.clip(ratio, 0.8, 1.2) * adv
    loss = -np.minimum(l1, l2) + 0.04 * kl
    per_row = lambda x: np.mean([(x * mask)[a[:, 0] == r].sum() / mask[a[:, 0] == r].sum()
                                 for r in range(5)])
    assert abs(s.kl - per_row(kl)) < 1e-12 and abs(s.loss - per_row(loss)) < 1e-12
    assert abs(s.clip_ratio - ((l1 < l2) * mask).sum() / mask.sum()) < 1e-12


# ---- B12 B15 B17 B18 ------------------------------------------------------------------

@pytest.mark.parametrize("name,expected", [("qwen2.5-vl-3b", 3000000000),
                                           ("x-8x7b", 56000000000), ("abc", -1),
                                           ("Qwen2-VL-2B-Instruct", 2000000000)])
def test_param_count(spark, name, expected):
    assert one(spark, names.param_count("n"), [(name,)], "n string")[0]["x"] == expected


@pytest.mark.parametrize("path,expected", [("/b/E/400_steps/f", "E"), ("/b/E/F/400_steps/f", "E"),
                                           ("/b/400_steps/f", "(unknown_exp)")])
def test_parse_experiment(spark, path, expected):
    assert one(spark, names.parse_experiment("p", "/b"), [(path,)], "p string")[0]["x"] == expected


def test_resolve_alias(spark):
    got = [r.x for r in spark.createDataFrame([(" VisualThinker ",), ("Other/Model",)], "n string")
           .select(names.resolve_alias("n").alias("x")).collect()]
    assert got == ["turningpoint-ai/VisualThinker-R1-Zero", "Other/Model"]


def test_extract_cot(spark):
    r = ("Question: q Answer: <think>a</think><think>b</think><think>open"
         "<answer>Answer: 4</answer>")
    row = spark.createDataFrame([(r,)], "r string").select(
        cot.cot_problem("r").alias("p"), cot.cot_solution("r").alias("s")).collect()[0]
    assert row.p == "q"
    assert row.s == "<think>a b</think>\n\n<answer>4</answer>"


def test_cot_keep(spark):
    df = spark.createDataFrame([("q", "<think></think>", 30, 30), ("q Answer:", "<think>a</think>", 30, 30),
                                ("q", "<think>a</think>", 27, 30), ("q", "<think>a</think>", 28, 28),
                                (None, None, None, None)],
                               "p string, s string, h int, w int")
    got = [r.k for r in df.select(cot.cot_keep("p", "s", "h", "w").alias("k")).collect()]
    assert got == [False, False, False, True, False]


# ---- B4 B8 B20 B22 --------------------------------------------------------------------

def test_image_paths_and_prompt(spark):
    df = spark.createDataFrame([("a.png",), ('["x.png", "/abs/y.png"]',), (None,)], "image string")
    out = df.select(prompts.normalise_image_paths("image", "/f").alias("p")).select(
        "p", prompts.make_prompt(F.col("p"), F.lit("Q")).alias("m")).collect()
    assert out[0].p == ["/f/a.png"] and out[1].p == ["/f/x.png", "/abs/y.png"] and out[2].p is None
    assert [c.type for c in out[1].m[0].content] == ["image", "image", "text"]
    assert [c.type for c in out[2].m[0].content] == ["text"]


def test_flatten_conversation_parity(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
         (1, 3, "user", "u2 <image>"), (2, 0, "assistant", "x"), (2, 1, "assistant", "y")],
        "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in records.flatten_conversations(turns).collect()}
    assert out[1].system_message == "S" and out[1].n_messages == 3
    assert out[1].prompt == "user: u1\nassistant: a1\nuser: u2 <image>\n\nassistant: "
    assert out[2].prompt == "user: x\nassistant: y"


def test_expand_image_tokens(spark):
    df = spark.createDataFrame([("a<image>b<image>", [1, 2])], "q string, k array<int>")
    r = df.select(prompts.expand_image_tokens("q", "k", 2).alias("x")).collect()[0].x
    ctx = prompts.IMG_CONTEXT
    assert r == f"a<img>{ctx * 2}</img>b<img>{ctx * 4}</img>"


# ---- B23 B24 --------------------------------------------------------------------------

def _nearest_grid(w, h, most=12, size=448):
    """Of all grids with the nearest ratio (by product, then columns) the last one that the
    image fills to more than half, else the first."""
    side = range(1, most + 1)
    grids = sorted((i * j, i, j) for i in side for j in side if i * j <= most)
    nearest = min(abs(w / h - i / j) for _, i, j in grids)
    tied = [g for g in grids if abs(w / h - g[1] / g[2]) == nearest]
    filled = [g for g in tied[1:] if 2 * w * h > size * size * g[0]]
    return (filled or tied[:1])[-1][1:]


def test_plan_tiles_bruteforce(spark):
    sizes = [(w, h) for w in (1, 28, 100, 448, 896, 1000, 1344, 2000) for h in (1, 28, 224, 448, 900, 1792)]
    df = spark.createDataFrame(sizes, "w int, h int")
    got = [(r.p.cols, r.p.rows) for r in df.select(vision.plan_tiles("w", "h").alias("p")).collect()]
    assert got == [_nearest_grid(w, h) for w, h in sizes]


def test_min_size(spark):
    df = spark.createDataFrame([(10, 100), (100, 10), (20, 20), (500, 600)], "w int, h int")
    got = [(r.s.width, r.s.height) for r in df.select(vision.min_size("w", "h").alias("s")).collect()]
    assert got == [(28, 280), (280, 28), (28, 28), (500, 600)]


# ---- G4-G7 ----------------------------------------------------------------------------

def test_exact_split_counts(spark):
    df = spark.range(15).withColumnRenamed("id", "doc_id")
    out = sampling.exact_split(df, "doc_id", 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"validation": 1, "train": 14}


def test_group_sampler_shape(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    out = sampling.group_sampler(df, "doc_id", mini_repeat=2, batch_size=4, repeat=3).collect()
    assert len(out) == 48
    assert sorted(r.sample_pos for r in out) == list(range(48))
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.sample_pos)]
    assert len(set(ids)) == 8
    first = ids[:24]
    assert first[0] == first[1] and first[:8] == first[8:16] == first[16:24]


def test_shuffle_positions_dense(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    pos = sorted(r.perm_pos for r in sampling.shuffle(df, "doc_id", 1, block_chars=1).collect())
    assert pos == list(range(1, 1001))


def test_pad_and_clip(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5, 6])], "b int, ids array<int>")
    left = {tuple(r.ids) for r in grpo.pad_sequences(df, "ids", "b", 0, "left").collect()}
    assert left == {(1, 2, 3), (0, 0, 4), (5, 6)}
    clipped = grpo.clip_rows(df, "b", max_samples=2, tokens="ids", cutoff_len=2).collect()
    assert len(clipped) == 2 and all(len(r.ids) <= 2 for r in clipped)


def test_keypoint_similarity_matches_numpy(spark):
    import numpy as np
    from gradebook.operators import detection as det
    rng = np.random.default_rng(1)
    g = rng.uniform(0, 100, size=(17, 3)); g[:, 2] = rng.integers(0, 3, 17)
    dkp = g.copy(); dkp[:, :2] += rng.normal(0, 3, size=(17, 2))
    bbox, area = [10.0, 20.0, 50.0, 60.0], 3000.0
    sig = np.array(det.KPT_OKS_SIGMAS); var = (sig * 2) ** 2
    vis = g[:, 2] > 0
    e = ((dkp[:, 0] - g[:, 0]) ** 2 + (dkp[:, 1] - g[:, 1]) ** 2) / var / (area + np.spacing(1)) / 2
    want = np.sum(np.exp(-e[vis])) / vis.sum()
    df = spark.createDataFrame([(dkp.ravel().tolist(), g.ravel().tolist(), bbox, area)],
                               "d array<double>, g array<double>, b array<double>, a double")
    got = df.select(det.keypoint_similarity(F.col("d"), F.col("g"), F.col("b"), F.col("a"))
                    .alias("o")).collect()[0].o
    assert abs(got - want) < 1e-12


def test_rows_with_null_key_or_order_keep_their_place(spark):
    from gradebook.operators.ranking import numeric_block, positions

    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k string, v long")
    got = positions(df, ["k"], ["v"], numeric_block("v", 10)).collect()
    assert len(got) == 3 and {r.pos for r in got if r.k is None} == {1}


def test_best_checkpoint_ignores_null_accuracy(spark):
    from gradebook.operators.evaluation import best_per_experiment

    df = spark.createDataFrame([("e", 1, None, 5, 1), ("e", 2, 50.0, 5, 2)],
                               "exp string, step int, accuracy_percent double, "
                               "total_samples long, correct_predictions long")
    row = best_per_experiment(df).first()
    assert (row["step"], row["accuracy_percent"]) == (2, 50.0)


def test_batch_predict_spoils_whole_batches_only(spark):
    from gradebook.operators.probe import batch_predict

    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, ""), (2, None), (None, "d")],
                               "batch int, prompt string")
    got = {(r.batch, r.prompt): r.generated_text
           for r in batch_predict(df, lambda xs: [x.upper() for x in xs]).collect()}
    bad = "error_empty_input_ids"
    assert got == {(0, "a"): "A", (0, "b"): "B", (1, "c"): bad, (1, ""): bad, (2, None): bad,
                   (None, "d"): "D"}


def test_streams_read_folders_in_any_order_of_time(spark, tmp_path):
    from gradebook.streaming import streams as st

    days = ["2024-03-03", "2024-03-02", "2024-01-01"]
    schema = st.EVENTS_SCHEMA
    for i, day in enumerate(days):
        rows = spark.range(3).selectExpr(*[
            f"cast({'timestamp ' + repr(day + ' 01:00:00') if f.name == 'ts' else 20} as "
            f"{f.dataType.simpleString()}) as {f.name}" for f in schema.fields])
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = st.read_table_stream(spark, str(tmp_path), "events", schema, files_per_trigger=1)
    out = st.run_updates(st.streaming_accuracy(stream), ["w", "exp"], "late")
    assert sum(r.total_samples for r in out.collect()) == 9


def test_exact_split_keeps_null_ids_and_rounds(spark):
    df = spark.createDataFrame([(i, "x") for i in range(23)] + [(None, "x")], "id long, v string")
    for rounding, want in (("floor", 7), ("ceil", 8)):
        out = sampling.exact_split(df, "id", 0.3, rounding=rounding).collect()
        assert len(out) == 24
        assert sum(r["split"] == "validation" for r in out) == want


def test_exact_split_of_an_empty_table(spark):
    assert sampling.exact_split(spark.createDataFrame([], "id long"), "id").collect() == []


def test_loaded_detections_keep_input_order_and_need_their_images(spark):
    from gradebook.operators import detection

    rows = [(8 - i, [float(i), 0.0, 2.0, 3.0], 0.5, i) for i in range(8)]
    dts = spark.createDataFrame(
        rows, "image_id long, bbox array<double>, score double, place long")
    images = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    out = detection.load_detections(dts, images, "place").orderBy("id").collect()
    assert [(r["id"], r["image_id"]) for r in out] == [(i + 1, 8 - i) for i in range(8)]
    assert {(r["area"], r["iscrowd"]) for r in out} == {(6.0, 0)}
    with pytest.raises(Exception, match="do not correspond"):
        detection.load_detections(dts, images.where("id < 8"), "place").collect()


def test_model_scores_of_null_texts(spark):
    from gradebook.operators import probe

    df = spark.createDataFrame([(1, "a", "bc"), (2, None, None)],
                               "id long, prompt string, completion string")
    out = probe.model_scores(df, lambda texts: [float(len(t)) for t in texts])
    assert {(r["id"], r["reward"]) for r in out.collect()} == {(1, 3.0), (2, 0.0)}
