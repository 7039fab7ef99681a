"""One huge JSON document read by many tasks.

The document is an object whose sections are arrays of records. It is read as text pieces that
end at commas, so Spark cuts the file by byte ranges at commas and a *block* of it can be any
part of a record. Whether a brace counts depends on all text before it; the scan is therefore
done twice:

1. each block reports its quotes and its change of depth for both cases, starting inside a
   string or not; prefix sums over the blocks (a few numbers each) give each block its true
   state;
2. each block cuts its records. Of a record that crosses block borders every block gives its
   fragment; fragments are put together by the block they began in. The section of a record is
   the last array that opened before it, in its block or an earlier one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored_table

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_STATE = "block long, quotes long, delta_0 long, delta_1 long"
_PARTS = "block long, place int, kind string, section string, text string"
#: Depth of a record: document, section array, record.
_RECORD = 3


def _scan(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quotes seen up to and including each byte, and the bytes' depth steps (as if outside
    strings)."""
    raw = np.frombuffer(body, np.uint8)
    quote = raw == 34
    slash = np.flatnonzero(raw == 92)
    if len(slash):
        first = np.append(True, np.diff(slash) != 1)
        run = slash - np.repeat(slash[first], np.diff(np.append(np.flatnonzero(first), len(slash))))
        odd = slash[run % 2 == 0] + 1  # the byte after an odd number of backslashes
        quote[odd[odd < len(raw)]] = False
    step = ((raw == 123) | (raw == 91)).astype(np.int8) - ((raw == 125) | (raw == 93))
    return np.cumsum(quote), step


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, pa.RecordBatch]]:
    """Runs of pieces of one block, joined by their commas."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for a, b in zip(cuts, [*cuts[1:], len(block)]):
            part = batch.slice(a, b - a)
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield int(block[a]), b",".join(texts) + b",", part


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list[int]] = {}
    for block, body, _ in _blocks(batches):
        seen, step = _scan(body)
        old = sums.setdefault(block, [0, 0, 0])
        inside = (seen + old[0]) % 2 == 1
        outside_0, outside_1 = int(step[~inside].sum()), int(step[inside].sum())
        sums[block] = [old[0] + int(seen[-1]), old[1] + outside_0, old[2] + outside_1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()),
         *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(3))],
        names=["block", "quotes", "delta_0", "delta_1"])


class _Cutter:
    """Cuts one block into records, head and tail fragments and section openings."""

    def __init__(self, block: int, quotes: int, depth: int) -> None:
        self.block, self.quotes, self.depth = block, quotes, depth
        self.section: bytes | None = None  # unknown: the last of an earlier block
        self.kind = "head" if depth >= _RECORD else None
        self.text: list[bytes] = []
        self.rows: list[tuple] = []
        self.place = 0

    def take(self, body: bytes) -> None:
        seen, step = _scan(body)
        outside = (seen + self.quotes) % 2 == 0
        moves = np.flatnonzero(outside & (step != 0))
        depth = self.depth + np.cumsum(step[moves], dtype=np.int64)
        at = 0
        # only openings of sections and borders of records matter
        for k in np.flatnonzero(((step[moves] > 0) & ((depth == 2) | (depth == _RECORD)))
                                | ((step[moves] < 0) & (depth == _RECORD - 1))).tolist():
            i, opens = int(moves[k]), step[moves[k]] > 0
            if opens and depth[k] == 2:
                key = _KEY.search(body, max(0, i - 4096), i)
                name = key.group(1) if key else b""
                self.section = name if body[i] == 91 else b"\0" + name  # not an array
                self._put("open", "")
            elif opens:
                self.kind, at = "record", i
                self.text = []
            elif self.kind:
                self.text.append(body[at:i + 1])
                self._put(self.kind, b"".join(self.text).decode("utf-8", "replace"))
                self.kind, self.text = None, []
        if self.kind:
            self.text.append(body[at:])
        self.quotes += int(seen[-1])
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def _put(self, kind: str, text: str) -> None:
        section = None if self.section is None else self.section.decode("utf-8", "replace")
        self.rows.append((self.block, self.place, kind, section, text))
        self.place += 1

    def end(self) -> None:
        if self.kind:  # a record goes on in the next block
            self._put("through" if self.kind == "head" else "tail",
                      b"".join(self.text).decode("utf-8", "replace"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter: _Cutter | None = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)],
            names=["block", "place", "kind", "section", "text"])
    for block, body, part in _blocks(batches):
        if cutter is None or cutter.block != block:
            if cutter is not None:
                cutter.end()
                yield packed(cutter.rows)
            cutter = _Cutter(block, part.column(2)[0].as_py(), part.column(3)[0].as_py())
        cutter.take(body)
        if len(cutter.rows) >= 10_000:
            yield packed(cutter.rows)
            cutter.rows = []
    if cutter is not None:
        cutter.end()
        yield packed(cutter.rows)


def document_records(spark: SparkSession, path: str) -> DataFrame:
    """``section, text``: the records (JSON objects) of the arrays of a document, in no order.
    The document is one file, or all files below a folder in the order of their paths, each but
    the last ending at a white space outside strings. Sections that are no arrays, and array
    elements that are no objects or arrays, give no rows; an empty file gives none."""
    raw = spark.read.option("lineSep", ",").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), "value")
    # blocks are numbered by file and place: a row for every 128 MB and file
    numbers = stored_table(raw.groupBy("file", "start").agg(F.lit(1).alias("one")).select(
        "file", "start", F.row_number().over(Window.orderBy("file", "start")).cast("long").alias(
            "block")), "document-blocks")
    pieces = raw.join(F.broadcast(numbers), ["file", "start"]).select("block", "value")
    states = stored_table(pieces.mapInArrow(_states, _STATE).groupBy("block").agg(
        *[F.sum(c).alias(c) for c in ("quotes", "delta_0", "delta_1")]), "document-states")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = states.withColumn("q", zero(F.sum("quotes").over(before))).withColumn(
        "delta", F.when(F.col("q") % 2 == 0, F.col("delta_0")).otherwise(F.col("delta_1")))
    starts = starts.select("block", (F.col("q") % 2).alias("q"),
                           zero(F.sum("delta").over(before)).alias("depth"))
    # one row per block of the file: a few numbers for every 128 MB
    parts = stored_table(pieces.join(F.broadcast(starts), "block").select(
        "block", "value", "q", "depth").mapInArrow(_cut, _PARTS), "document-parts")

    per_block = parts.groupBy("block").agg(
        F.max_by("section", F.when(F.col("kind") == "open", F.col("place"))).alias("last_section"),
        F.max((F.col("kind") == "tail").cast("int")).alias("has_tail"))
    at = F.when(F.col("has_tail") == 1, F.col("block"))
    known = states.select("block").join(per_block, "block", "left").select(
        "block", F.last("last_section", True).over(before).alias("section_before"),
        F.last(at, True).over(before).alias("tail_before"))
    rows = parts.where("kind <> 'open'").join(F.broadcast(known), "block").select(
        "block", "kind", F.coalesce("section", "section_before").alias("section"), "text",
        "tail_before")
    whole = rows.where("kind = 'record'").select("section", "text")
    owner = F.when(F.col("kind") == "tail", F.col("block")).otherwise(F.col("tail_before"))
    joined = rows.where("kind <> 'record'").groupBy(owner.alias("owner")).agg(
        F.sort_array(F.collect_list(F.struct("block", "text", "section"))).alias("f"))  # one record
    put = joined.select(F.col("f")[0]["section"].alias("section"),
                        F.array_join(F.col("f.text"), "").alias("text"))
    return whole.unionByName(put).where(~F.col("section").startswith("\0"))


def read_sections(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The named sections of a document, typed by their schema; an absent section is an empty
    table of that schema."""
    records = stored_table(document_records(spark, path), "document-records")
    return {name: records.where(F.col("section") == name).select(
        F.from_json("text", schema).alias("r")).select("r.*") for name, schema in schemas.items()}
