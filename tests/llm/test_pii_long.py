"""Personal data in texts with very many hits: spans and masks against a plain restatement."""

import random
import re
import time

import pytest

from gradebook.llm import pii


def _plain_emails(text):
    return [m.span() for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]


def _plain_mask(text, spans):
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _log(n, seed=3):
    rng = random.Random(seed)
    words = ["mail", "né", "host", "😀", "call", "x\n", "contact", "card", ""]
    kinds = [lambda i: f"u{i}@h{i % 7}.org", lambda i: f"10.{i % 256}.3.{i % 300}",
             lambda i: "4111 1111 1111 1111", lambda i: f"+49 (30) {1000000 + i}",
             lambda i: f"{100 + i % 900}-{10 + i % 90}-{1000 + i % 9000}"]
    return "".join(" ".join(rng.choices(words, k=rng.randrange(4))) + " "
                   + kinds[rng.randrange(5)](i) + " " for i in range(n))


@pytest.mark.parametrize("n", [1, 31, 32, 33, 200, 3000])
def test_spans_context_and_mask(spark, n):
    text = _log(n)
    df = spark.createDataFrame([(text, 7)], "text string, _entities int")
    row = pii.with_entities(df, out="found").first()
    found = row.found
    assert [(s.start, s.end) for s in found if s.kind == "email"] == _plain_emails(text)
    assert all(text[s.start:s.end] == s.value for s in found)
    assert [(s.start, s["rank"]) for s in found] == sorted((s.start, s["rank"]) for s in found)
    for s in found:
        near = re.search(pii.CONTEXT_WORDS[s.kind], text[max(0, s.start - 40):s.start].lower())
        assert s.score == min(1.0, pii.PRIOR[s.kind] + (0.3 if near else 0.0))
    assert pii.redact(df).first().text == _plain_mask(
        text, [(s.start, s.end, s.kind) for s in found])


def test_time_follows_the_hits(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"u{i}@host.org" for i in range(n)),)], "text string")
        start = time.time()
        out = pii.redact(df).first().text
        assert out == " ".join(["[EMAIL]"] * n)
        return time.time() - start

    seconds(1000)
    assert seconds(100_000) < 60
