"""Filter audit, SimHash join and source divergence against brute force, with edge cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gradebook.llm import divergence, filter_audit, simhash

SF = "/root/testdata/sf0.001"
DOC = ("doc_id long, text string, lang string, source string, n long, mask int, words string, "
       "part string, digest string, fp long, path int, label long, item string, value long")
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
NONE = (7, 7, "x", "x", "x", 7, 7, 7, "x", 7)  # columns whose names clash with helpers


def _rows():
    rnd = random.Random(5)
    out = [(1, "same text", "en", "a"), (2, "same text", "en", "a"), (2, "same text", "en", None),
           (3, None, "en", "b"), (4, "", None, "b"), (None, "same text", None, None),
           (None, "# MANY CAPITALS", "fr", "b"), (5, "é " * 60, "fr", "a"), (6, "ÀB cd-E1f", "", "")]
    for i in range(10, 140):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 90)))
        if i % 7 == 0:
            text = text.upper()
        if i % 11 == 0:
            text += " $5 | 100%"
        out.append((i, text, rnd.choice(["en", "en", "fr"]), rnd.choice(["a", "b", None, "c"])))
    out.append((200, "long " * 60000 + "tail", "en", "c"))
    out += [(201, out[20][1], "en", "c"), (202, out[20][1], "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + NONE for r in _rows()], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [
    (None, 1, 1), (12, None, 1), (12, 1, None), (999, 1, 1)]


def _audit_brute_force(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, _, source in rows:
        text = text or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
        bad = {c for c, f in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and i > first[text])) if f}
        fails.append((source or "", bad, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(c in f[1] for f in mine) - len(gone),
                    sum(f[1] == {c} for f in mine), sum(f[2] for f in gone),
                    sum(f[3] for f in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def test_filter_audit_against_brute_force(spark, docs, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:]
           for r in filter_audit.audit(docs, labels).collect()}
    assert got == _audit_brute_force(_rows(), LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def _print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42)
         for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def _components(prints):
    """Smallest index reachable over differences of at most three bits."""
    label = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    return label


def _by_component(rows):
    groups = defaultdict(set)
    for i, c in rows:
        groups[c].add(i)
    return sorted(map(sorted, groups.values()))


def test_simhash_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    prints = [_print(t) for _, t in rows]
    label = _components(prints)
    want = [(i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, label)]
    got = sorted((r.doc_id, r.fingerprint, r.component_id)
                 for r in simhash.near_duplicates(table).collect())
    assert got == want


def test_simhash_edges(docs, none):
    rows = _rows()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.fingerprint, r.component_id))
    assert by_id[3] == by_id[4] == {("0" * 16, 3)}
    assert by_id[1] == by_id[2] and {c for _, c in by_id[1]} == {1}
    assert (f"{_print('same text'):016x}", 1) in by_id[None]
    assert by_id[200] == {(f"{_print(rows[-3][1]):016x}", 200)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_in_pieces(monkeypatch):
    text = "A b  cc\td " * 50 + "é"
    whole = simhash.fingerprint(text.encode())
    assert whole & (1 << 64) - 1 == _print(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("limit", [2, 8, 2048])
def test_simhash_large_variants_lose_no_link(spark, limit):
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 1 << 62, 4).tolist():
        for _ in range(90):  # dense groups: variants far above the limit
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(df, limit).collect()
    at = {x: i for i, x in enumerate(signed)}
    label = list(range(len(prints)))
    for e in found:
        a, b = label[at[e.a]], label[at[e.b]]
        label = [min(a, b) if v == max(a, b) else v for v in label]
    assert label == _components(prints)


def _terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            word += c.lower()
        elif "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _divergence_brute_force(rows):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = {(r[2] or "", r[3] or "") for r in rows}
    for _, text, lang, source in rows:
        counts[lang or "", source or ""].update(_terms(text))
        held[lang or ""].update(set(_terms(text)))
    vocabulary = {lang: [t for t, n in c.items() if n >= 30] for lang, c in held.items()}

    def shares(count, vocab):
        total = sum(count[t] for t in vocab) + 5 * len(vocab)
        return {t: 1 + 10**9 * (count[t] + 5) // total for t in vocab}
    p = {g: shares(counts[g], vocabulary[g[0]]) for g in groups}
    out = set()
    for lang, source in groups:
        mine, vocab = p[lang, source], vocabulary[lang]
        q = shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), vocab)
        parts = {"pair": [(other, sum(abs(mine[t] - p[lang, other][t]) for t in vocab))
                          for of, other in groups if of == lang and other != source],
                 "term": [(t, mine[t] - q[t]) for t in vocab
                          if counts[lang, source][t] and mine[t] > q[t]]}
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (item, value)
                    in enumerate(found if part == "pair" else found[:50])}
    return out


@pytest.mark.parametrize("tile, block", [(32, 4096), (2, 3), (1, 1)])
def test_divergence_against_brute_force(docs, none, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5 if tile < 32 else 1 << 18)
    got = [tuple(r) for r in divergence.audit(docs).select(
        "lang", "source", "part", "item", "value", "rank").collect()]
    assert set(got) == _divergence_brute_force(_rows()) and len(got) == len(set(got))
    assert divergence.audit(none).count() == 0


def test_divergence_is_exact_for_large_counts():
    counts = np.array([0, 3, 10**13], np.int64)
    assert divergence._share_of(counts, 10**13 + 3, 3).tolist() == [
        1 + 10**9 * (c + 5) // (10**13 + 18) for c in counts.tolist()]
