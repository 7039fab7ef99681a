"""Language identification with interpolated Kneser-Ney character models.

Training. Per language a model of order ``ORDER`` over characters is fitted on labelled rows
only (language not NULL, document not held out). ``SAMPLE`` is the documented bound of that
fit: about that many documents per language, picked by a hash of the text so that source, id
and label play no part; languages with fewer rows use them all. Characters are lower-cased
and each run of non-letters is one space. Counts are taken in Spark tasks and summed per
(language, n-gram); the summed tables are bounded by the sample and built into a model on
the driver: for every n-gram of any language one row of interpolated log-probabilities (one
column per language), kept in hash order, and for every context a row of back-off weights.

Prediction. Each position of a text takes its longest known n-gram by binary search in the
sorted hashes, backing off with the stored weights; the language with the lowest
cross-entropy per character wins (ties: first by name). ``score`` is the winner's posterior
over at most ``EVIDENCE`` characters, in 0..1. Calibration: on labelled sample documents kept
out of the counts, the cross-entropies under their own language give per language the level
``mean + REJECT_SIGMA * sd + REJECT_BITS``; a text above its winner's level (plus an allowance
for short texts) is rejected: ``accepted`` is false.

Defined cases: NULL text or text without a letter gives ``und``, score 0, not accepted; with
no labelled row at all every text is ``und``; NULL doc_id counts as not held out; repeated
rows are predicted alike; extra columns are not read by :func:`predict` and pass through
:func:`keep_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stored
from .textstats import mix, utf8

ORDER = 5
SAMPLE = 400
CALIBRATION_SHARE = 0.25
HELD_OUT = 1
EVIDENCE = 20
REJECT_SIGMA = 4.0
REJECT_BITS = 0.75
SHORT_TEXT_BITS = 6.0
UNKNOWN = "und"
CHUNK = 1 << 19
_GRAM_MULT = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, n int, gram long, ctx long, rest long, count long"
PREDICTED = ("doc_id long, held_out boolean, lang_pred string, score double, "
             "cross_entropy double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


class _Letters:
    """Code point -> lower-case letter (0: no letter), for the whole code space, on demand."""

    table = np.zeros(0, np.uint32)

    @classmethod
    def upto(cls, top: int) -> np.ndarray:
        if top >= len(cls.table):
            size = 0x800 if top < 0x800 else 0x10000 if top < 0x10000 else 0x110000
            low = [ord(c.lower()) if len(c.lower()) == 1 else i
                   for i, c in enumerate(map(chr, range(size)))]
            alpha = np.array([chr(i).isalpha() for i in range(size)])
            cls.table = np.where(alpha, low, 0).astype(np.uint32)
        return cls.table


def _cuts(body: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, byte starts, byte ends) of groups of about ``CHUNK`` bytes; a longer
    text is cut every ``CHUNK`` bytes from its start, at a character border."""
    numbers, starts, ends, total = [], [], [], 0
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        while a < b:
            to = min(b, a + CHUNK)
            while to < b and body[to] & 0xC0 == 0x80:
                to += 1
            numbers.append(i)
            starts.append(a)
            ends.append(to)
            total += to - a
            a = to
            if total >= CHUNK:
                yield np.array(numbers), np.array(starts), np.array(ends)
                numbers, starts, ends, total = [], [], [], 0
    if numbers:
        yield np.array(numbers), np.array(starts), np.array(ends)


def _characters(body: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Letters in lower case with one space per run of other characters, ``ORDER - 1`` spaces
    before each piece: (code points, scored characters per piece, letters per piece)."""
    part = body[starts[0]:ends[-1]]
    borders = np.append(starts, ends[-1]) - starts[0]
    heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[borders]
    codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letter = _Letters.upto(int(codes.max()))[codes]
    other = letter == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    keep[heads[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[heads]
    letters = np.concatenate([[0], np.cumsum(~other)])[heads]
    sizes = np.diff(kept)
    pad = ORDER - 1
    out = np.full(kept[-1] + pad * len(sizes), 32, np.uint32)
    values = letter[keep]
    values[values == 0] = 32
    out[np.arange(kept[-1]) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)] = values
    return out, sizes, np.diff(letters)


def _base(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or int(codes.max()) < len(_BASES):
        return _BASES[codes]
    return mix(codes.astype(np.uint64) + np.uint64(1))


_BASES = mix(np.arange(0x3000, dtype=np.uint64) + np.uint64(1))


def gram_at(base: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """Hash of the n characters that end at each of the positions ``at`` (None: at every
    position from n-1 on)."""
    with np.errstate(over="ignore"):
        if at is None:
            run = base[n - 1:].copy()
            for k in range(1, n):
                run += base[n - 1 - k:len(base) - k] * _power(k)
        else:
            run = base[at]
            for k in range(1, n):
                run += base[at - k] * _power(k)
        run += np.uint64(n)
        return run * _GRAM_MULT ^ (run >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_GRAM_MULT), n, 1 << 64))


def _scored_positions(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(
        (ORDER - 1) * np.arange(1, len(sizes) + 1), sizes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        langs = batch.column(0)
        for lang in sorted(set(langs.to_pylist())):
            own = batch.column(1).filter(pa.compute.equal(langs, lang))
            body, offs = utf8(own)
            for _, starts, ends in _cuts(body, offs):
                codes, sizes, _ = _characters(body, starts, ends)
                base, at = _base(codes), _scored_positions(sizes)
                for n in range(1, ORDER + 1):
                    g, first, count = np.unique(gram_at(base, at, n), return_index=True,
                                                return_counts=True)
                    where = at[first]
                    zero = np.zeros(len(g), np.uint64)
                    ctx = gram_at(base, where - 1, n - 1) if n > 1 else zero
                    rest = gram_at(base, where, n - 1) if n > 1 else zero
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g)), pa.array(np.full(len(g), n, np.int32)),
                         pa.array(g.view(np.int64)), pa.array(ctx.view(np.int64)),
                         pa.array(rest.view(np.int64)), pa.array(count.astype(np.int64))],
                        names=names)


def _texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.string()))


class Sorted:
    """A sorted hash array; the leading bits of a hash name the slot where its search starts."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        heads = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        last = len(self.keys) - 1
        at = self.start[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        np.minimum(at, last, out=at)
        miss = np.flatnonzero(self.keys[at] != wanted)
        for _ in range(self.longest - 1):
            if not len(miss):
                return at
            at[miss] = np.minimum(at[miss] + 1, last)
            miss = miss[self.keys[at[miss]] < wanted[miss]]
        at[self.keys[at] != wanted] = -1
        return at


class Model:
    """Sorted hash arrays with one column of log2 values per language."""

    def __init__(self, langs: list[str], counts) -> None:
        """``counts``: columns lang (number), n, gram, ctx, rest, count as numpy arrays."""
        self.langs = langs
        size = len(langs)
        lang, order, gram, ctx, rest, raw = counts
        self.grams, self.logs, self.ctxs, self.backs = [], [], [], []
        lower, self.level = None, np.full(size, np.inf)
        letters = len(np.unique(gram[order == 1])) + 1
        for n in range(1, ORDER + 1):
            here = order == n
            keys = np.unique(gram[here])
            amount = np.zeros((len(keys), size))
            if n == ORDER:
                np.add.at(amount, (np.searchsorted(keys, gram[here]), lang[here]), raw[here])
            else:  # continuation counts: distinct longer n-grams that end in this one
                longer = order == n + 1
                pos = np.searchsorted(keys, rest[longer])
                pos[pos == len(keys)] = 0
                known = keys[pos] == rest[longer]
                np.add.at(amount, (pos[known], lang[longer][known]), 1)
                first = np.zeros((len(keys), size))
                np.add.at(first, (np.searchsorted(keys, gram[here]), lang[here]), 1)
                amount = np.maximum(amount, first)
            of = np.zeros(len(keys), np.uint64)
            tail = np.zeros(len(keys), np.uint64)
            of[np.searchsorted(keys, gram[here])] = ctx[here]
            tail[np.searchsorted(keys, gram[here])] = rest[here]
            ones, twos = (amount == 1).sum(0), (amount == 2).sum(0)
            discount = np.where(ones > 0, ones / np.maximum(1, ones + 2 * twos), 0.5)
            if n == 1:
                total, kinds = amount.sum(0), (amount > 0).sum(0)
                spread = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                floor = np.log2(np.maximum(spread, 1e-12) / letters)
                prob = (np.maximum(amount - discount, 0) / np.maximum(total, 1)
                        + np.exp2(floor))
                self.floor = floor.astype(np.float32)
                self.ctxs.append(np.zeros(0, np.uint64))
                self.backs.append(np.zeros((0, size), np.float32))
            else:
                heads, which = np.unique(of, return_inverse=True)
                total = np.zeros((len(heads), size))
                kinds = np.zeros((len(heads), size))
                np.add.at(total, which, amount)
                np.add.at(kinds, which, amount > 0)
                back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                back = np.maximum(back, 1e-12)
                under = lower[1][np.searchsorted(lower[0], tail)]
                prob = (np.maximum(amount - discount, 0) / np.maximum(total[which], 1)
                        + back[which] * under)
                self.ctxs.append(heads)
                self.backs.append(np.log2(back).astype(np.float32))
            self.grams.append(keys)
            self.logs.append(np.log2(prob).astype(np.float32))
            lower = (keys, prob)
        self.grams = [Sorted(k) for k in self.grams]
        self.ctxs = [Sorted(k) for k in self.ctxs]

    def position_logs(self, base: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 probability of the character at each position, per language."""
        pos = self.grams[-1].find(gram_at(base, None, ORDER)[at - (ORDER - 1)])
        out = self.logs[-1].take(pos, axis=0, mode="clip")
        todo = np.flatnonzero(pos < 0)
        out[todo] = 0
        for n in range(ORDER, 0, -1):
            here = at[todo]
            if n < ORDER:
                pos = self.grams[n - 1].find(gram_at(base, here, n))
                hit = pos >= 0
                out[todo[hit]] += self.logs[n - 1][pos[hit]]
                todo, here = todo[~hit], here[~hit]
            if not len(todo):
                return out
            if n > 1:
                pos = self.ctxs[n - 1].find(gram_at(base, here - 1, n - 1))
                known = pos >= 0
                out[todo[known]] += self.backs[n - 1][pos[known]]
        out[todo] += self.floor
        return out

    def entropies(self, body: np.ndarray, offs: np.ndarray):
        """(bits per character per language, characters, letters) of each text."""
        n = len(offs) - 1
        bits, chars, letters = np.zeros((n, len(self.langs))), np.zeros(n), np.zeros(n)
        for numbers, starts, ends in _cuts(body, offs):
            codes, sizes, own = _characters(body, starts, ends)
            logs = self.position_logs(_base(codes), _scored_positions(sizes))
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            np.add.at(bits, numbers, -np.add.reduceat(logs, heads, axis=0, dtype=np.float64))
            np.add.at(chars, numbers, sizes)
            np.add.at(letters, numbers, own)
        return bits / np.maximum(chars, 1)[:, None], chars, letters

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        bits, _, _ = self.entropies(*_texts(texts))
        for i, lang in enumerate(self.langs):
            own = bits[[x == lang for x in langs], i]
            own = own[np.isfinite(own)]
            if len(own):
                self.level[i] = own.mean() + REJECT_SIGMA * own.std() + REJECT_BITS


def fit(docs: DataFrame) -> Model | None:
    """Fit and calibrate the model; None without labelled rows."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                        & F.col("text").isNotNull())
    sizes = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "lang-sizes")
    def uniform(start: int) -> Column:
        return F.conv(F.substring(F.md5("text"), start, 8), 16, 10).cast("double") / 2.0**32
    sample = usable.select("lang", "text").join(sizes, "lang").withColumn(
        "draw", uniform(1) * F.col("rows") / F.lit(float(SAMPLE))).where(F.col("draw") < 1).select(
        "lang", "text", (uniform(9) < CALIBRATION_SHARE).alias("calibrates"))
    sample = sample.persist()
    try:
        table = sample.where("not calibrates").select("lang", "text").mapInArrow(
            _count, COUNTS).groupBy("lang", "n", "gram").agg(
            F.min("ctx").alias("ctx"), F.min("rest").alias("rest"),
            F.sum("count").alias("count")).toArrow()
        kept = sample.where("calibrates").select("lang", "text").toArrow()
    finally:
        sample.unpersist()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    numbers = {x: i for i, x in enumerate(langs)}
    column = {c: table.column(c).to_numpy() for c in table.column_names if c != "lang"}
    model = Model(langs, (
        np.array([numbers[x] for x in table.column("lang").to_pylist()]), column["n"],
        *(column[c].view(np.uint64) for c in ("gram", "ctx", "rest")), column["count"]))
    known = kept.filter(pa.compute.is_in(kept.column("lang"), pa.array(langs)))
    model.calibrate(known.column("text").to_pylist(), known.column("lang").to_pylist())
    return model


def _predict(model: Model | None, body: np.ndarray, offs: np.ndarray):
    """(language, score, cross-entropy, accepted) of each text, as lists."""
    n = len(offs) - 1
    if model is None:
        return [UNKNOWN] * n, [0.0] * n, [None] * n, [False] * n
    bits, chars, letters = model.entropies(body, offs)
    best = bits.argmin(1)
    lowest = bits[np.arange(n), best]
    odds = np.exp2(-(bits - lowest[:, None]) * np.minimum(chars, EVIDENCE)[:, None]).sum(1)
    known = letters > 0
    ok = known & (lowest <= model.level[best] + SHORT_TEXT_BITS / np.sqrt(np.maximum(chars, 1)))
    return ([model.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())],
            np.where(known, 1 / odds, 0.0).tolist(),
            [x if k else None for x, k in zip(lowest.tolist(), known.tolist())], ok.tolist())


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language, score, cross-entropy and acceptance of every text of ``docs``."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in PREDICTED.split(", ")]
        for batch in batches:
            cols = _predict(shared.value, *utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *(pa.array(c, t) for c, t in zip(cols, types))], names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, PREDICTED)


def keep_accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, with all their columns."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = free_name(docs, "_accepted")

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        return pa.array(_predict(shared.value, *utf8(text))[3], pa.bool_())
    return docs.withColumn(flag, accepted(F.col("text"))).where(F.col(flag)).drop(flag)
