"""Decontamination at its borders: short and one-size benchmarks, alike corpora, row drops."""

import pytest

from gradebook.llm import decontam

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, _leak string, _digest int"
ITEM = "item_id long, text string"


def _text(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.mark.parametrize("sizes", [(24,), (20, 24), (30, 59), (8,), (1,), (3, 30), (7, 7)])
def test_verbatim_items_of_any_size(spark, sizes):
    items = [(k, _text(k, n)) for k, n in enumerate(sizes)]
    clean = [(100 + k, _text(50 + k, 90), None, k) for k in range(30)]
    rows = clean + [(k, _text(80, 40) + " " + t + " " + _text(81, 33), None, 1) for k, t in items]
    found = decontam.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, k) for k, _ in items]


def test_short_items_need_their_own_words(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "?!"), (3, None)], ITEM)
    rows = [(1, "so what is the capital of france then", "", 0), (2, "what is the", "", 0),
            (2, "capital of France", "", 0), (3, None, "", 0), (None, "What is the capital of France",
                                                               "", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id or 0, r.item_id, r.kind) for r in decontam.leaks(docs, bench).collect())
    assert got == [(0, 1, "copy"), (1, 1, "copy")]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_alike_corpus(spark):
    docs = spark.createDataFrame([(k, _text(1, 24), "", 0) for k in range(5)], DOC)
    bench = spark.createDataFrame([(1, _text(1, 24)), (2, _text(2, 24))], ITEM)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {
        (k, 1) for k in range(5)}


def test_rows_are_dropped_by_their_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, "clean one", "a", 1), (None, item, "b", 2), (None, _text(3, 60), None, 3),
            (7, _text(4, 60) + " " + item, "c", 4), (7, "clean two", "d", 5), (8, None, "e", 6),
            (9, "", "f", 7), (9, "", "f", 7)]
    docs = spark.createDataFrame(rows, DOC)
    kept = decontam.drop_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept.columns == docs.columns
    assert sorted(r._digest for r in kept.collect()) == [1, 3, 5, 6, 7, 7]


def test_fit_on_a_sample_finds_the_same_copies(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontam.leaks(table, bench).collect()}
    want = pairs()
    monkeypatch.setattr(decontam, "FIT_PASSAGES", 1 << 11)
    monkeypatch.setattr(decontam, "TOKENS", 500)
    assert want and pairs() == want


def test_the_fit_reads_every_text(spark, monkeypatch):
    """No passage is left out, however many there are."""
    monkeypatch.setattr(decontam, "FIT_PASSAGES", 8)
    docs = spark.createDataFrame([(k, _text(k % 7, 48 + k), "", 0) for k in range(200)], DOC)
    tokens = decontam.stored(decontam.hashed_texts(docs), "fit-test")
    seen, summed = [], decontam._summed

    def counted(rows, *args):
        seen.append(rows.count())
        return summed(rows, *args)
    monkeypatch.setattr(decontam, "_summed", counted)
    space = decontam.fit(tokens)
    assert seen == [200, 200, 200]
    counts = summed(tokens, decontam._count_passages, (decontam.FEATURES * 2,), 2)
    assert counts[decontam.FEATURES] == sum(-(-(48 + k) // decontam.STEP) for k in range(200))
    assert space is not None and len(space.mean)
