"""Benchmark decontamination by latent semantic retrieval.

1. Every text is hashed to words once; the hashed texts are a stored table that all later
   passes read. Words fall into ``FEATURES`` hashed features; passages are ``PASSAGE`` words.
2. Passage frequencies over all documents give the TF-IDF weights. A randomised SVD of the
   passage x feature matrix follows: each task multiplies its passages with a random matrix
   and its transpose back (``A'A R``), the fixed-size products are summed in Spark, and a
   second pass over the range's basis gives singular values and directions. Latent vectors
   are whitened and centred.
3. Benchmark items are cut into query passages. Windows of ``24`` words (short items) and
   ``48`` words slide over all texts in steps of ``STEP`` words; a window whose latent cosine
   with a query passage reaches ``COSINE`` is a candidate.
4. A candidate must share TF-IDF mass with the passage (``SHARED``); then the longest common
   subsequence of the whole item and the text around the window decides: ``COPY`` of the item's
   words in order is a copy; ``PARAPHRASE`` of them is one if the answer check holds as well.
   The answer is the column ``answer`` if the benchmark has one, else the words after the
   last question mark; ``ANSWER_PART`` of them must occur there. An item with neither has no
   answer to check: ``PARAPHRASE`` of its words decide, if they stand so densely that the
   shortest run of words that holds them is at most ``SPREAD`` times as long as the item.

Query passages are read in blocks of ``QUERIES`` (a fixed bound on what is broadcast); more
items mean more passes, none is left out.

Defined cases: NULL or empty texts and items match nothing; items of fewer than ``MIN_WORDS``
words, and all items where the texts are too few or too alike to span a latent space, are
found word for word only; NULL ids are kept as they are; repeated rows are judged alike; empty
tables give no rows; extra columns pass through :func:`drop_leaks`, which judges each row by
its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stored
from .textstats import PUNCTUATION, utf8, words

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
STEP = 12
PASSAGE = 24
RANK = 96
OVERSAMPLE = 8
WINDOWS = (2, 4)  # in steps: 24 and 48 words
COSINE = 0.36
SHARED = 0.45
COPY = 0.7
PARAPHRASE = 0.5
SPREAD = 1.5
ANSWER_PART = 0.8
MIN_WORDS = 8
QUERIES = 4096
SEED = 5
#: Words of a piece of joined texts: with RANK 96 its latent rows take about 25 MB.
TOKENS = 1 << 17
#: Passages (about) after which a task of the fit sends its sums on, which are packed in single
#: precision: counts in them stay exact. All passages are summed.
FIT_PASSAGES = 1 << 20
MEMBERS = 1 << 12
SUMS = "part int, total binary"
LEAK = ("doc_id long, item_id long, cosine double, lcs double, answer double, kind string, "
        "start_word long, digest binary")


def hashed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, words`` (32-bit word hashes as bytes) and ``digest`` of every text with
    words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hashes, upto = words(*utf8(batch.column(1)), PUNCTUATION)
            raw = (hashes >> np.uint64(32)).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([raw[4 * a:4 * b] for a, b in zip(
                    upto[:-1].tolist(), upto[1:].tolist())], pa.binary()), batch.column(2)],
                names=["doc_id", "words", "digest"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       _digest().alias("digest")).mapInArrow(
        run, "doc_id long, words binary, digest binary").where(F.octet_length("words") > 0)


def _digest():
    """128 bits that equal texts share."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _chunks(batch: pa.RecordBatch, column: int = 0):
    """Joined words of consecutive texts, about ``TOKENS`` at a time, with their offsets.
    Each text is filled up to whole steps with the feature-less word 0 (flagged)."""
    body, offs = utf8(batch.column(column))
    values, offs = body.view(np.uint32) if len(body) % 4 == 0 else body[:0].view(np.uint32), offs // 4
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + TOKENS, "right")) - 1)
        own = offs[a:b + 1] - offs[a]
        sizes = np.diff(own)
        padded = -(-sizes // STEP) * STEP
        begin = np.concatenate([[0], np.cumsum(padded)])
        out = np.zeros(begin[-1], np.uint32)
        real = np.zeros(begin[-1], bool)
        where = np.arange(own[-1]) + np.repeat(begin[:-1] - own[:-1], sizes)
        out[where] = values[offs[a]:offs[b]]
        real[where] = True
        yield a, b, out, real, begin
        a = b


def _features(values: np.ndarray) -> np.ndarray:
    return (values & np.uint32(FEATURES - 1)).astype(np.int32)


def _summed(tokens: DataFrame, work, shape: tuple[int, ...], parts: int) -> np.ndarray:
    """Sum over all batches of ``work(batch) -> float array of shape``, cut into ``parts``
    along its first axis and added in streaming tasks; the result has a fixed size."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(shape, np.float64), 0
        for batch in batches:
            if size > FIT_PASSAGES * PASSAGE * 4:
                yield packed(dict(enumerate(np.split(total, parts))))
                total, size = np.zeros(shape, np.float64), 0
            work(batch, total)
            size += batch.nbytes
        yield packed(dict(enumerate(np.split(total, parts))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(*(batch.column(i).to_pylist() for i in range(2))):
                own = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[part] = sums[part] + own if part in sums else own
        yield packed(sums)

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())],
            names=["part", "total"])
    rows = tokens.select("words").mapInArrow(local, SUMS).repartition("part").mapInArrow(
        add, SUMS).collect()
    out = np.zeros((parts, int(np.prod(shape)) // parts))
    for row in rows:
        out[row["part"]] = np.frombuffer(row["total"], np.float32)
    return out.reshape(shape)


def _count_passages(batch: pa.RecordBatch, total: np.ndarray) -> None:
    """Passages of one step per feature; the last entry counts all passages."""
    for _, _, values, real, _ in _chunks(batch):
        feats = np.where(real, _features(values), -1).reshape(-1, STEP)
        feats = np.sort(feats, axis=1)
        new = feats >= 0
        new[:, 1:] &= feats[:, 1:] != feats[:, :-1]
        total[:FEATURES] += np.bincount(feats[new], minlength=FEATURES)
        total[FEATURES] += len(feats)


def _rows(values: np.ndarray, real: np.ndarray, table: np.ndarray, steps: int) -> np.ndarray:
    """Sum of the feature rows of ``table`` over each run of ``steps`` steps (dropping a
    shorter end)."""
    feats = np.where(real, _features(values), FEATURES)
    width = STEP * steps
    n = len(feats) // width
    feats = feats[:n * width].reshape(n, width)
    out = np.empty((n, table.shape[1]), table.dtype)
    more = np.empty((min(n, 512), table.shape[1]), table.dtype)  # pieces that stay in the cache
    for a in range(0, n, 512):
        b = min(n, a + 512)
        np.take(table, feats[a:b, 0], axis=0, out=out[a:b], mode="clip")
        for k in range(1, width):
            out[a:b] += np.take(table, feats[a:b, k], axis=0, out=more[:b - a], mode="clip")
    return out


class Latent:
    """Whitened latent space: ``vector = sum of table rows`` less ``mean`` per step."""

    def __init__(self, idf: np.ndarray, table: np.ndarray, mean: np.ndarray) -> None:
        self.idf, self.table, self.mean = idf, table, mean


def fit(tokens: DataFrame) -> Latent | None:
    """Randomised SVD of the TF-IDF passages of all texts; None without any passage."""
    counts = _summed(tokens, _count_passages, (FEATURES * 2,), 2)
    total = counts[FEATURES]
    if not total:
        return None
    idf = np.zeros(FEATURES + 1, np.float32)
    idf[:FEATURES] = np.log((total + 1) / (counts[:FEATURES] + 1))
    columns = min(RANK + OVERSAMPLE, FEATURES)
    steps = PASSAGE // STEP
    start = np.random.default_rng(SEED).standard_normal((FEATURES + 1, columns)).astype(
        np.float32) * idf[:, None]
    spark = tokens.sparkSession
    first = spark.sparkContext.broadcast((idf, start))

    def project(batch: pa.RecordBatch, out: np.ndarray) -> None:
        weights, table = first.value
        for _, _, values, real, _ in _chunks(batch):
            rows = _rows(values, real, table, steps)
            n = len(rows) * PASSAGE
            feats = np.where(real[:n], _features(values[:n]), FEATURES).astype(np.uint16)
            order = np.argsort(feats, kind="stable")
            feats = feats[order]
            heads = np.flatnonzero(np.concatenate([[True], feats[1:] != feats[:-1]])) \
                if n else np.zeros(0, np.int64)
            if n:
                sums = np.empty((len(heads), rows.shape[1]), np.float32)
                ends = np.append(heads[1:], n)
                at = 0
                while at < len(heads):  # pieces of the gathered rows that stay in the cache
                    to = max(at + 1, int(np.searchsorted(ends, heads[at] + (1 << 12))))
                    part = rows[order[heads[at]:ends[to - 1]] // PASSAGE]
                    sums[at:to] = np.add.reduceat(part, heads[at:to] - heads[at], axis=0)
                    at = to
                which = feats[heads]
                keep = which < FEATURES
                out[which[keep]] += sums[keep] * weights[which[keep]][:, None]
    range_ = _summed(tokens, project, (FEATURES, columns), 64)
    basis = np.linalg.qr(range_)[0].astype(np.float32)
    table = np.zeros((FEATURES + 1, columns), np.float32)
    table[:FEATURES] = basis * idf[:FEATURES, None]
    second = spark.sparkContext.broadcast(table)

    def gram(batch: pa.RecordBatch, out: np.ndarray) -> None:
        for _, _, values, real, _ in _chunks(batch):
            rows = _rows(values, real, second.value, steps)
            out[:columns] += rows.T @ rows
            out[columns] += rows.sum(0)
            out[columns + 1, 0] += len(rows)
    made = _summed(tokens, gram, (columns + 2, columns), 1)
    n = max(1.0, made[columns + 1, 0])
    mean = made[columns] / n
    values, vectors = np.linalg.eigh(made[:columns] / n - np.outer(mean, mean))
    keep = np.argsort(-values)[:RANK]
    keep = keep[values[keep] > 1e-9]
    turn = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    return Latent(idf, table @ turn, (mean @ turn / steps).astype(np.float32))


class Item:
    """A benchmark item: its words, answer words and lookup tables."""

    def __init__(self, item_id, text: str, answer: str | None) -> None:
        self.item_id = item_id
        self.words = _words(text)
        if answer:
            self.answer = _words(answer)
        else:
            self.answer = _words(text[text.rfind("?") + 1:]) if "?" in text else self.words[:0]
        self.bits: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            self.bits[w] = self.bits.get(w, 0) | 1 << i

    def lcs(self, other: list[int]) -> int:
        """Length of the longest common subsequence, one bit row per word of ``other``."""
        full = (1 << len(self.words)) - 1
        row = full
        for w in other:
            hit = row & self.bits.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(self.words) - row.bit_count()


    def dense(self, other: list[int]) -> bool:
        """Whether a run of ``SPREAD`` item lengths holds ``PARAPHRASE`` of the words in order
        (runs begin every 16th of the item and are longer by that)."""
        step = max(1, len(self.words) // 16)
        width = int(SPREAD * len(self.words)) + step
        return any(self.lcs(other[a:a + width]) >= PARAPHRASE * len(self.words)
                   for a in range(0, len(other), step))


def _words(text: str) -> np.ndarray:
    _, hashes, _ = words(*utf8(pa.array([text])), PUNCTUATION)
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _runs(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(0, len(values) - width + 1)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[j:j + n]
            out ^= out >> np.uint64(29)
    return out


class Queries:
    """Query passages of some items, per window size; items too short for the latent search,
    or all of them where the space is empty, as exact word sequences."""

    def __init__(self, items: list[Item], space: Latent) -> None:
        self.space = space
        exact = [i for i in items if len(i.words) < MIN_WORDS or not len(space.mean)]
        self.exact: dict[int, dict[int, list[Item]]] = {}
        for item in exact:
            of_width = self.exact.setdefault(len(item.words), {})
            key = int(_runs(item.words.astype(np.uint64), len(item.words))[0])
            of_width.setdefault(key, []).append(item)
        items = self.items = [i for i in items if len(i.words) >= MIN_WORDS and len(space.mean)]
        self.owner, self.vectors, self.members, self.mass = {}, {}, {}, {}
        for steps in WINDOWS:
            width = steps * STEP
            own = []
            for i, item in enumerate(items):
                n = len(item.words)
                if steps == WINDOWS[0] and n <= width:
                    own.append((i, item.words))
                elif steps == WINDOWS[1] and n > WINDOWS[0] * STEP:
                    for a in range(0, max(1, n - width // 2), width // 2):
                        own.append((i, item.words[a:a + width]))
            self.owner[steps] = np.array([i for i, _ in own], np.int64)
            vec = np.array([space.table[_features(w)].sum(0) - space.mean * (len(w) / STEP)
                            for _, w in own], np.float32).reshape(len(own), len(space.mean))
            norm = np.linalg.norm(vec, axis=1, keepdims=True)
            self.vectors[steps] = vec / np.maximum(norm, 1e-9)
            table = np.zeros((len(own), MEMBERS), bool)
            for row, (_, w) in zip(table, own):
                row[w & np.uint32(MEMBERS - 1)] = True
            self.members[steps] = table
            self.mass[steps] = np.array([space.idf[_features(np.unique(w))].sum() for _, w in own])

    def verbatim(self, values: np.ndarray, real: np.ndarray, begin: np.ndarray):
        """(item, text, first word) of the exact word sequences in the joined texts."""
        if not self.exact:
            return
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        for width, keys in self.exact.items():
            runs = _runs(values.astype(np.uint64), width)
            known = np.array(list(keys), np.uint64)
            for x in np.flatnonzero(np.isin(runs, known)).tolist():
                y = x + width - 1
                if text[x] == text[y] and real[x:y + 1].all():
                    for item in keys[int(runs[x])]:
                        if (values[x:y + 1] == item.words).all():
                            yield item, int(text[x]), x

    def candidates(self, values: np.ndarray, real: np.ndarray, begin: np.ndarray):
        """(item, first word, end word, cosine) of windows of the joined texts."""
        single = _rows(values, real, self.space.table, 1)
        single -= self.space.mean
        feats = np.where(real, _features(values), FEATURES)
        for steps in WINDOWS:
            queries, owner = self.vectors[steps], self.owner[steps]
            if not len(owner) or not len(single):
                continue
            ends = np.minimum(np.arange(len(single)) + steps, np.repeat(
                begin[1:] // STEP, np.diff(begin) // STEP))
            rows = single.copy()
            for k in range(1, steps):  # the next steps of the same text, added in place
                inside = np.flatnonzero(np.arange(len(single)) + k < ends)
                rows[inside] += single[inside + k]
            rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None], 1e-9)
            width = steps * STEP
            for a in range(0, len(rows), 8192):
                near = rows[a:a + 8192] @ queries.T
                w, q = np.nonzero(near >= COSINE)
                for part in range(0, len(w), 1 << 16):
                    w_, q_ = w[part:part + (1 << 16)], q[part:part + (1 << 16)]
                    first = (w_ + a) * STEP
                    last = ends[w_ + a] * STEP
                    spot = first[:, None] + np.arange(width)[None, :]
                    inside = spot < last[:, None]
                    spot = np.minimum(spot, len(values) - 1)
                    f = np.where(inside, feats[spot], FEATURES)
                    hit = self.members[steps][q_[:, None], values[spot] & np.uint32(MEMBERS - 1)]
                    weight = self.space.idf[f]
                    shared = (weight * hit).sum(1)
                    ok = shared >= SHARED * np.minimum(self.mass[steps][q_], weight.sum(1))
                    for i, x, y, c in zip(owner[q_[ok]], first[ok], last[ok],
                                          near[w_[ok], q_[ok]]):
                        yield int(i), int(x), int(y), float(c)


def _judge(item: Item, near: np.ndarray):
    """(lcs part, answer part (None without an answer), kind or None) of an item and the words
    around a window."""
    part = item.lcs(near.tolist()) / len(item.words)
    answer = float(np.isin(item.answer, near).mean()) if len(item.answer) else None
    if part >= COPY:
        return part, answer, "copy"
    if part >= PARAPHRASE and (
            item.dense(near.tolist()) if answer is None else answer >= ANSWER_PART):
        return part, answer, "paraphrase"
    return part, answer, None


def _item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text",
                            answer.cast("string").alias("answer")).where("text is not null")
    block: list[Item] = []
    for row in rows.toLocalIterator():
        item = Item(row["item_id"], row["text"], row["answer"])
        if len(item.words):
            block.append(item)
        if len(block) == QUERIES:
            yield block
            block = []
    if block:
        yield block


def leak_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every hit of a text and an item (one text may hit an item in several places), with the
    text's digest."""
    spark = docs.sparkSession
    tokens = stored(hashed_texts(docs), "decontam-words")
    space = fit(tokens)
    none = tokens.where("false").mapInArrow(lambda batches: batches, LEAK)
    if space is None:
        return none
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Queries(block, space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _found(batch, shared.value)
        found = tokens.mapInArrow(run, LEAK)
        out = found if out is None else out.unionByName(found)
    return none if out is None else out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) that it holds: best cosine, LCS and answer parts, kind.
    Items of fewer than ``MIN_WORDS`` words are found word for word only, items without words
    never. Rows without doc_id, and rows that repeat one, are found together under it."""
    best = F.max_by(F.struct("lcs", "answer", "kind", "start_word"), F.struct(
        "lcs", "cosine", F.col("start_word") * -1)).alias("b")
    return leak_rows(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), best).select(
        "doc_id", "item_id", "cosine", "b.lcs", "b.answer", "b.kind", "b.start_word")


def _found(batch: pa.RecordBatch, queries: Queries) -> pa.RecordBatch:
    ids, digests = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    out = []
    for a, _, values, real, begin in _chunks(batch, 1):
        for item, d, x in queries.verbatim(values, real, begin):
            out.append((ids[a + d], item.item_id, 1.0, 1.0, None, "copy", int(x - begin[d]),
                        digests[a + d]))
        judged: dict[tuple[int, int, int], tuple] = {}
        for i, x, y, cosine in queries.candidates(values, real, begin):
            item = queries.items[i]
            d = int(np.searchsorted(begin, x, "right")) - 1
            reach = len(item.words)
            low, high = max(begin[d], x - reach), min(begin[d + 1], y + reach)
            key = (i, int(low), int(high))
            if key not in judged:
                judged[key] = _judge(item, values[low:high][real[low:high]])
            part, answer, kind = judged[key]
            if kind:
                out.append((ids[a + d], item.item_id, cosine, part, answer, kind,
                            int(x - begin[d]), digests[a + d]))
    cols = list(zip(*out)) if out else [[]] * 8
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(),
             pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, types)],
        names=[c.split()[0] for c in LEAK.split(", ")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item. A row goes by its own text,
    whatever its doc_id."""
    key, leak = free_name(docs, "_digest"), free_name(docs, "_leak")
    found = stored(leak_rows(docs, benchmark).select(F.col("digest").alias(leak)).distinct(),
                   "decontam-leaks")
    rows = docs.withColumn(key, _digest())
    return rows.join(found, F.col(key) == F.col(leak), "left_anti").drop(key)
