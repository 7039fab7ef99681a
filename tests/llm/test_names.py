"""Extra columns named like helpers go through every stage of the pipeline."""

import corpus_pipeline

HELPERS = ("cut of epochs cut_words source_size_ key block rest budget words ahead _plan _set _least "
           "_key _own _row _digest _leak label node sid n").split()


def test_helper_names_pass_every_stage(spark):
    text = "the quick brown fox jumps over the lazy dog and runs through the green forest today "
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in HELPERS)
    rows = [(i, text * 3 + f"number {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en",
             ["a", "b"][i % 2], 10, *[f"{c}{i}" for c in HELPERS]) for i in range(8)]
    rows.append((99, None, None, None, None, *[None] * len(HELPERS)))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "decontaminate":
            out = stage(spark, docs, "/root/testdata/sf0.001")
        else:
            out = stage(spark, docs, "")
        got = {r.doc_id: r for r in out.collect()}
        assert set(range(8)) & set(got), name
        for c in HELPERS:
            assert all(r[c] == f"{c}{i}" for i, r in got.items() if i != 99), (name, c)
        if name != "mix":
            assert out.columns == docs.columns, name
