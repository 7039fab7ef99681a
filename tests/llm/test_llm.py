"""Edge cases and brute-force checks of the training-data operators on small fixtures."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradebook.llm import (ann, chat, decontam, html_text, jaccard, langid, licenses, mixing, pii,
                           suffix_dedup)
from gradebook.llm.shared import among, stored

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
ROWS = [(1, LONG * 3, "en", "a", 1, 7), (2, LONG * 3, "en", None, 1, 7), (2, LONG * 3, "en", None, 1, 7),
        (3, "", "en", "a", 0, 7), (4, None, None, "b", None, None), (None, "x", "en", "b", 1, 7),
        (5, "mail a@b.co or 4111 1111 1111 1111, +1 (555) 123-4567 at 10.0.0.1", "en", "b", 1, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_suffix_dedup_edges(docs, none):
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans)
                  for r in suffix_dedup.deduplicate(docs).collect()))
    n = len(LONG * 3)
    assert got == [(0, 1, 0, 0), (1, n, 0, 0), (2, n, n, 1), (2, n, n, 1), (3, 0, 0, 0),
                   (4, 0, 0, 0), (5, len(ROWS[-1][1]), 0, 0)]
    assert suffix_dedup.deduplicate(none).count() == 0


def _windows(entries):
    """Per new entry of (suffix, before, id, new) the windows that a smaller document has."""
    g, out = suffix_dedup.GRAM, []
    for s, b, who, new in entries:
        mask = 0
        for t, c, other, _ in entries:
            if new and other < who and t[:g] == s[:g]:
                for l in range(suffix_dedup.SIDE + 1):
                    r = g + suffix_dedup.SIDE - l
                    if min(len(b), len(c)) >= l and min(len(s), len(t)) >= r \
                            and b[len(b) - l:] == c[len(c) - l:] and s[:r] == t[:r]:
                        mask |= 1 << l
        out.append(mask)
    return out


@pytest.mark.parametrize("paired", [1, 3, 64])
def test_merged_entries_share_their_windows(monkeypatch, paired):
    """Groups compared pair by pair, by hash, and both, against plain comparison; entries of small
    groups are not hashed."""
    rng, entries = random.Random(6), []
    for n in (1, 2, 2, 3, 5, 9, 40):
        head = bytes(rng.choices(b"abcdefgh", k=suffix_dedup.GRAM))
        for _ in range(n):
            after = bytes(rng.choices(b"x\0", weights=[40, 1], k=rng.choice([3, 20, 34])))
            before = bytes(rng.choices(b"y\0", weights=[40, 1], k=rng.choice([0, 10, 34])))
            entries.append((head + after, before, rng.randrange(8), rng.random() < 0.7))
    entries.sort(key=lambda e: e[0])
    monkeypatch.setattr(suffix_dedup, "PAIRED", paired)
    hashed = []
    monkeypatch.setattr(suffix_dedup, "_hash_masks", lambda *x, f=suffix_dedup._hash_masks: (
        hashed.append(len(x[1])) or f(*x)))
    rows = pa.record_batch([pa.array(x) for x in zip(*entries)], ["suffix", "before", "ord", "new"])
    rows = rows.append_column("ctx", pa.array(range(len(entries))))
    got = dict(zip(range(len(entries)), [0] * len(entries)))
    for batch in suffix_dedup._merge_scan(iter([rows])):
        got |= dict(zip(batch.column("ctx").to_pylist(), batch.column("mask").to_pylist()))
    want = _windows(entries)
    assert list(got.values()) == want and any(want)
    assert hashed == {1: [61], 3: [54], 64: []}[paired]


def test_decided_contexts_whatever_the_order():
    rows = [(2, 5, 9), (2, 5, 4), (2, 5, 4), (2, 6, 7), (4, 8, 3), (4, 8, 3), (3, 1, 6), (6, 5, 1)]
    want = sorted([(9, 5, -1), (4, 5, 0), (7, 6, 0), (6, 1, -1)])
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        batch = pa.record_batch([pa.array(x) for x in zip(*rows)], ["fp", "ctx", "ord"])
        found = next(suffix_dedup._decide(iter([batch])))
        assert sorted(zip(*(c.to_pylist() for c in found.columns))) == want


def test_mix_meets_targets_and_repeats(docs, none):
    a, b = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert a == b and len(a) == len(ROWS)
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0


def test_personal_data_and_mask(docs, none):
    row = pii.digest(docs).where("doc_id = 5").first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    text = pii.redact(docs).where("doc_id = 5").first().text
    assert text == "mail [EMAIL] or [CARD], [PHONE] at [IP]"
    assert pii.digest(docs).where("doc_id = 4").first().spans == ""
    assert pii.digest(none).count() == 0


@pytest.mark.parametrize("text, spans", [
    ("a@b.com_x@d.com", "email:0:7,email:7:15"),
    ("1.2.3.4.5.6.7.8 1.2.3.999", "ip:0:7,ip:8:15"),
    ("GB82WEST12345698765432", "iban:0:22"), ("GB82WEST12345698765433", ""),
    ("ssn 123-45-6789", "ssn:4:15"), ("123-45-6789", ""),
    ("é" * 3 + "+49 (30) 1234567.", "phone:3:19"), ("1" * 5000 + "-" * 50, "")])
def test_personal_data_spans(spark, text, spans):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.digest(df).first().spans.split(",")
    assert [s for s in got if not s.startswith("card")] == spans.split(",")


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s><|x|>\\"), (1, 1, "assistant", "a[b]<\n"), (1, 1, None, None),
            (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = hashlib.sha256(b"user\n</s><|x|>\\\n\n\nassistant\na[b]<\n\n").hexdigest()
    assert got[1].turns_sha256 == want and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"a[b]<\n").hexdigest()
    assert got[None].loss_chars == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_finds_templates_that_rewrite_history():
    def last_only(turns):
        return "".join(("*" if i == len(turns) - 1 else "-") + t for i, (_, t) in enumerate(turns))
    assert chat.locate(last_only, [("user", "a"), ("user", "b"), ("user", "c")])[3] == 2


def test_chat_renders_every_prefix_of_any_template(spark):
    """A template that rewrites history, and one whose turns depend on each other, give the
    same spans through Spark as prefixes cut by hand; the default one rewrites nothing."""
    turns = [(("user", "assistant")[i % 2], "x" * (i % 7) + ("" if i % 5 else "</s>[|\\"))
             for i in range(120)]
    df = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)],
                               "conv_id long, turn long, role string, text string")

    def last_only(rows):
        return "".join(("*" if i == len(rows) - 1 else "-") + t for i, (_, t) in enumerate(rows))

    def numbered(rows):
        return "".join(f"<{i}:{r}>{t}\n" for i, (r, t) in enumerate(rows))

    rewritten = chat.format_conversations(df, last_only).first()
    assert rewritten.rewrites == len(turns) - 1 and rewritten.formatted == last_only(turns)
    for template in (numbered, chat.default_template):
        row = chat.format_conversations(df, template).first()
        ends = [len(template(turns[:i])) for i in range(len(turns) + 1)]
        assert row.rewrites == 0 and row.formatted == template(turns)
        assert [(s.start, s.end) for s in row.turn_spans] == list(zip(ends, ends[1:]))
        escaped = chat.escape if template is chat.default_template else str
        assert [row.formatted[s.start:s.end] for s in row.loss_spans] == [
            escaped(t) for r, t in turns if r == "assistant"]


def test_language_id_held_out_accuracy_and_edges(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    edge = {r.doc_id: r.lang_pred for r in langid.predict(docs).collect()}
    assert edge[3] == edge[4] == "und"
    assert langid.predict(none).count() == 0


def test_jaccard_against_brute_force(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in table.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(
            {c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    edge = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.near_duplicates(docs).collect())
    assert edge == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert jaccard.near_duplicates(none).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.keep_first(docs).collect()) == [0, 1, 3, 4, 5]


def test_decontamination_finds_copies_and_paraphrases(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    changed = " ".join("other" if i % 4 == 1 else w for i, w in enumerate(item.text.split()))
    planted = spark.createDataFrame([(10**6, LONG * 5 + item.text + " " + LONG * 5),
                                     (10**6 + 1, changed)], "doc_id long, text string")
    found = decontam.leaks(table.select("doc_id", "text").unionByName(planted),
                           spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {r.doc_id for r in found if r.item_id == item.item_id} >= {10**6, 10**6 + 1}
    bench = spark.createDataFrame([(1, None), (2, "too short")], "item_id long, text string")
    assert decontam.leaks(docs, bench).count() == 0
    assert decontam.leaks(none, bench).count() == 0


def test_keep_first_takes_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (5, b + " end"), (7, c), (7, d),
            (8, d + " end"), (9, c), (None, ""), (None, None), (11, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_first(df).collect())
    one = [x for x in got if x[1] and x[1].startswith("a0 ")]
    assert len(one) == 1 and got.pop(one[0]) == 1 and one[0][0] is None
    assert got == collections.Counter([(5, b + " end"), (7, c), (7, d), (None, ""), (None, None),
                                       (11, " ")])


def test_jaccard_joins_rows_without_own_ids_by_set(spark):
    """Many rows with a NULL id or one repeated id, each text with one near copy: one text
    per set is fetched (not rows times sets), and one row of each pair stays."""
    n = 300
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(2 * n)]
    rows = [(None if k < n else 7, t + end) for k, t in enumerate(texts) for end in ("", " end")]
    df = spark.createDataFrame(rows + [(None, texts[0])] * 3, "doc_id long, text string")
    sketch = stored(jaccard.sketches(df), "test-sketch")
    wanted = sketch.select("sid").distinct()
    made = jaccard.set_table(df, sketch, wanted).collect()
    assert len(made) == len({r.sid for r in made}) == 4 * n
    assert all(jaccard.set_id(np.frombuffer(r.elements, np.uint64)) == r.sid for r in made)
    kept = [(r.doc_id, r.text.removesuffix(" end")) for r in jaccard.keep_first(df).collect()]
    assert sorted(kept, key=str) == sorted(
        [(None if k < n else 7, t) for k, t in enumerate(texts)], key=str)


def test_jaccard_fetches_only_sets_of_pairs(spark, monkeypatch):
    """Sets of different components that share a posted shingle but make no pair are not made,
    and the sets are made without a shuffle of their elements."""
    tables = collections.defaultdict(list)

    def kept(df, name):
        tables[name].append(stored(df, name))
        return tables[name][-1]
    monkeypatch.setattr(jaccard, "stored", kept)
    near = " ".join(f"n{i}" for i in range(60))
    rows = ["a b c d e", "x a b c d e", *["x a b c d"] * 3, near, near + " end"]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}
    assert max(t.select("sid").distinct().count() for t in tables["jaccard-mixed"]) == 2
    made = [r.sid for t in tables["jaccard-sets"] for r in t.collect()]
    both = {x for t in tables["jaccard-pairs"] for r in t.collect() for x in (r.a, r.b)}
    assert len(made) == 2 and set(made) == both
    sketch = tables["jaccard-sketch"][0]
    plan = jaccard.set_table(df, sketch, sketch.select("sid").distinct())
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text.split("MapInArrow")[0]


def test_pipeline_stages_start_no_more_python_than_they_need(spark, none):
    """A text is hashed once by keep_first (no second Python step in the filters derived from
    it), and the hits are read without a Python RDD beside them: idle workers take memory."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(jaccard.keep_first(df)).count("ArrowEvalPython") == 2  # with words, without
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    found = decontam.leak_rows(df, bench)
    assert "RDD" not in plan(found) and found.collect()[0].doc_id == 1
    assert decontam.leak_rows(df, bench.where("false")).collect() == []
    empty = decontam.leak_rows(none, bench)
    assert empty.columns == found.columns and empty.collect() == []


def _kept_tables(monkeypatch):
    tables = collections.defaultdict(list)

    def kept(df, name):
        tables[name].append(stored(df, name))
        return tables[name][-1]
    monkeypatch.setattr(jaccard, "stored", kept)
    return tables


def test_jaccard_makes_no_set_of_a_chance_pair(spark, monkeypatch):
    """Two texts that share a passage, their other words being more frequent, so that it leads
    both prefixes: the suffix filter drops the pair before a set is made."""
    tables = _kept_tables(monkeypatch)
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [f"{run('s', 60)} {run(own, 40)}" for own in "uv"] + [
        f"{run(own, 40)} {run(f'{own}{k}x', 400)}" for own in "uv" for k in range(6)]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in jaccard.near_duplicates(df).collect())
    sid = {r.doc_id: r.sid for r in tables["jaccard-sketch"][0].collect()}
    near = {(r.a, r.b) for r in tables["jaccard-near"][0].collect()}
    assert tuple(sorted((sid[0], sid[1]))) in near
    assert not sum(t.count() for t in tables["jaccard-sets"])


def test_jaccard_verifies_a_pair_once(spark, monkeypatch):
    """Pairs that a round has verified in vain do not come back in later rounds, and all pairs
    of up to ALL_PAIRED sets of a shingle are taken in the first."""
    tables = _kept_tables(monkeypatch)
    shared = " ".join(f"s{i}" for i in range(90))
    rows = [shared + "".join(f" {own}{i}" for i in range(11)) for own in "abcdefghi"]
    often = [(" ".join(t.split()[86:]) + " ") * 30 for t in rows]  # else these words lead prefixes
    df = spark.createDataFrame([*enumerate(rows + often)], "doc_id long, text string")
    sets = [{*zip(*(t.split()[i:] for i in range(5)))} for t in rows]
    assert all(100 * len(x & y) < 80 * len(x | y) for x in sets for y in sets if x is not y)
    assert all(r.doc_id == r.component_id for r in jaccard.near_duplicates(df).collect())
    taken = collections.Counter(r for t in tables["jaccard-pairs"] for r in t.collect())
    assert taken and max(taken.values()) == 1
    few = spark.createDataFrame([(k, 40 + k, k + 100, [7]) for k in range(jaccard.ALL_PAIRED)],
                                "doc_id long, n long, sid long, keys array<long>")
    assert jaccard.near_pairs(jaccard.shared_postings(few)).count() == 6


def test_range_counts_are_read_back():
    elements = np.sort(np.concatenate([np.arange(70000), np.arange(300) + (5 << 57)]).astype(np.uint64))
    got = jaccard.counts_of(pa.array([jaccard.range_counts(elements)], pa.binary()))
    assert got.shape == (1, jaccard.RANGES) and (got[0, 0], got[0, 5]) == (0xFFFF, 300)
    assert got.sum() == 0xFFFF + 300


def test_among_keeps_all_wanted_rows(spark):
    df = spark.range(20000).selectExpr("nullif(id, 3) AS `k.1`", "id AS _word")
    wanted = df.where("_word % 100 = 0 OR _word = 3").select("`k.1`")
    got = {r._word for r in among(df, "k.1", wanted).collect()}
    assert {3, *range(0, 20000, 100)} <= got and len(got) < 220
    assert among(df, "k.1", wanted).columns == df.columns
    assert among(df, "k.1", wanted.limit(0)).isEmpty()


def test_decontamination_without_answers(spark):
    rng = np.random.default_rng(3)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r for r in bench.collect() if len(r.text.split()) >= 24]
    rows, want = [], set()
    for k, item in enumerate(items):
        w = item.text.split()
        gone = {*range(len(w) - 5, len(w))} | {
            *rng.choice(len(w) - 5, round(len(w) * 0.36) - 5, replace=False).tolist()}
        rows.append((10**6 + k, LONG * 3 + " ".join(
            f"other{i}" if i in gone else x for i, x in enumerate(w)) + " " + LONG * 3))
        want.add((10**6 + k, item.item_id))
        half = {*rng.choice(len(w), round(len(w) * 0.7), replace=False).tolist()}
        rows.append((2 * 10**6 + k, " ".join(
            f"other{i}" if i in half else x for i, x in enumerate(w))))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(
        table.unionByName(planted), bench).collect() if r.doc_id >= 10**6}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_license_scan(spark, docs, none):
    text = ("words before it " * 30 + "Licensed under the Apache License, Version 2.0. " +
            licenses.TEMPLATES["MIT-notice"] + " tail " * 40)
    df = spark.createDataFrame([(1, text), (2, "nothing of this kind here at all")],
                               "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.start_word, r.containment) for r in licenses.scan(df).collect()}
    assert got == {(1, "Apache-2.0"): (90, 1.0), (1, "MIT-notice"): (98, 1.0)}
    assert licenses.scan(docs).count() == licenses.scan(none).count() == 0


def test_license_scan_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    names = {"MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0",
             "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0",
             "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0"}
    line = re.compile(r"\b[a-z]+ under (?:the )?(%s)(?![\w.]*\d)" % "|".join(map(re.escape, names)),
                      re.I)
    lower = {k.lower(): v for k, v in names.items()}
    want = collections.Counter((r.doc_id, lower[m.group(1).lower()]) for r in table.collect()
                               for m in line.finditer(r.text or ""))
    got = collections.Counter((r.doc_id, r.license) for r in licenses.scan(table).collect())
    assert got == want and sum(want.values()) == 39
    assert sum(n for (_, license), n in want.items() if license == "MIT") == 10


def test_license_statements_and_bodies(spark):
    rows = [(1, "Released under the MIT License."), (2, "Released under the Apache License 2.0"),
            (3, "// SPDX-License-Identifier: MIT"), (4, "das ist mit Lizenz"),
            (5, "Code available under the terms of the Mozilla Public License 2.0."),
            (6, "Released under CC BY-SA 4.0 by us"), (7, "the MIT License"),
            (8, "released under the"), (9, "GNU General Public License v2"),
            (10, "Distributed under the GNU General Public License, version 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.end_word) for r in licenses.scan(df).collect()) == [
        (1, "MIT", 5), (2, "Apache-2.0", 7), (3, "MIT", 4), (5, "MPL-2.0", 12),
        (6, "CC-BY-SA-4.0", 7), (10, "GPL-2.0", 9)]
    texts = collections.defaultdict(list)
    for name, section in licenses.license_texts():
        texts[name].append(section)
    assert len(texts) == 10
    bodies = [(i, "words " * 30 + " ".join(texts[name][1:])) for i, name in enumerate(texts)]
    found = {(r.doc_id, r.license) for r in licenses.scan(
        spark.createDataFrame(bodies, "doc_id long, text string")).collect()}
    assert found >= set(enumerate(texts))


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain  words", "plain words"),
    ("<nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>" + "some text " * 9 +
     "<p>Or.<div class='comments'>reader</div></article><footer>f</footer>",
     "A & B\n" + ("some text " * 9).strip() + "\nOr."),
    ("<script>x('</p>')</script><div class=cookie-notice>ok</div></b><main>body</main>", "body")])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_nearest_neighbours_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(10)]
    rows += [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (None, rows[0][1]),
             (203, [1.0, 2.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows
            if i is not None and v and len(v) == 6 and np.isfinite(v).all() and any(v)}
    for q in (0, 50, 100):
        near = sorted((-round(float(good[q] @ v), 12), i) for i, v in good.items() if i != q)
        assert got[q] == [i for _, i in near[:5]]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
