"""Chat formatting by incremental black-box rendering.

A template is any callable ``render(turns) -> str`` over ``[(role, text), ...]``; nothing
about its inside is used. For each conversation the successive prefixes of its turns are
rendered and consecutive outputs compared: what a prefix adds is the span of its last turn,
and an output that does not start with the one before it means that the template rewrote
history (counted in ``rewrites``; the span then starts where the outputs part). The text
inside a turn is located by rendering the same prefix with two probe texts that differ in
their first and last characters: the common start and end of the two outputs are the
turn's frame. Spans of assistant texts form the loss mask.

The default template marks each turn as ``<|role|>`` + newline + text + ``</s>`` + newline.
Inside roles and texts a backslash goes before each of ``\\ < [ |``, so no control string
(``<s>``, ``</s>``, ``<|..|>``, ``[INST]``, ``[/INST]``) can appear there, and removing the
backslashes restores the text.

Defined cases: NULL text and role count as empty; rows with equal turn are ordered by role
and text (NULLs first), repeated rows stay; NULL conv_id is one conversation; an empty table
gives no rows; extra columns are not read. A conversation is one string in the result, so
its rows meet in one task; every prefix is rendered whole, which costs its length times its
turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]

# Escaped characters, the probes and the role under the loss mask.
_ESCAPED = "\\<[|"
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|((?:[^\\|]+|\\.)*)\|>\n((?:[^\\<]+|\\.)*)</s>\n", re.S)
PROBES = ("a", "b")
LOSS_ROLE = "assistant"
FORMATTED = ("conv_id long, n_turns long, formatted string, rewrites long, "
             "turn_spans array<struct<start:long,end:long>>, "
             "loss_spans array<struct<start:long,end:long>>")
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
          "loss_sha256 string, formatted_chars long, rewrites long")
BATCH = 256


def escape(text: str) -> str:
    for c in _ESCAPED:  # the backslash first
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_template(turns: Turns) -> str:
    return "".join(f"<|{escape(role)}|>\n{escape(text)}</s>\n" for role, text in turns)


def parse(formatted: str) -> Turns:
    """Turns of a text made by the default template."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix (halving, so comparisons stay in C)."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(render: Render, turns: Turns) -> tuple[str, list, list, int]:
    """(output, turn spans, loss spans, number of prefixes that rewrote history)."""
    before, spans, loss, rewrites = render([]), [], [], 0
    for i, (role, text) in enumerate(turns):
        now = render(turns[:i + 1])
        if now.startswith(before):
            start = len(before)
        else:
            start = _common(before, now)
            rewrites += 1
        spans.append((start, len(now)))
        if role == LOSS_ROLE:
            one, two = (render([*turns[:i], (role, probe)]) for probe in PROBES)
            head = _common(one, two)
            tail = _common(one[head:][::-1], two[head:][::-1])
            loss.append((head, len(now) - tail))
        before = now
    return before, spans, loss, rewrites


def _conversations(batches: Iterator[pa.RecordBatch]):
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3))))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, [(role or "", text or "") for _, role, text in group]


def format_conversations(df: DataFrame, render: Render = default_template) -> DataFrame:
    """One row per conversation: the formatted text, turn spans, loss spans, rewrites.

    ``df`` has conv_id, turn, role, text. Rows are dealt by conv_id and sorted, so each
    conversation is a run of rows that streams through its task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv_id, turns in _conversations(batches):
            text, spans, loss, rewrites = locate(render, turns)
            done.append((conv_id, len(turns), text, rewrites, spans, loss))
            if len(done) >= BATCH:
                yield _formatted(done)
                done = []
        if done:
            yield _formatted(done)

    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _formatted(done: list) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ids, n, texts, rewrites, spans, loss = zip(*done)

    def structs(lists):
        return pa.array([[{"start": a, "end": b} for a, b in x] for x in lists], span)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(texts, pa.string()),
         pa.array(rewrites, pa.int64()), structs(spans), structs(loss)],
        names=["conv_id", "n_turns", "formatted", "rewrites", "turn_spans", "loss_spans"])


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted texts and digest what they hold: the turns, and the text under the
    loss mask with its escapes removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in row["loss_spans"])
                out.append((row["conv_id"], len(turns),
                            _hex("".join(f"{r}\n{t}\n" for r, t in turns)),
                            len(loss), _hex(loss), len(text), row["rewrites"]))
            if out:
                names = [c.split()[0] for c in DIGEST.split(", ")]
                types = [pa.string() if "sha256" in c else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)
    return formatted.select("conv_id", "formatted", "loss_spans", "rewrites").mapInArrow(
        run, DIGEST)
