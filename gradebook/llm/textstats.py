"""Vectorised word and shingle hashing of UTF-8 columns (numpy inside Arrow tasks).

A word is a maximal run of bytes other than space and 0x09-0x0D; the letters A-Z count as
a-z. Word hashes are 64 bits; hashes of different words collide with probability 2**-64
each, which the callers accept and name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_SEGMENT = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_MULT = 0xD6E8FEB86659FD93


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


_BYTE = _byte_values()
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True

#: Separators that also drop punctuation: every ASCII byte that is no letter or digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)],
                               np.multiply.accumulate(np.full(n, base, np.uint64))])


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = _powers(_SEGMENT, _BASE)
    down = _powers(_SEGMENT, pow(_BASE, -1, 1 << 64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(cls.up) - 1:
            return cls.up, cls.down
        return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0]:offs[-1]], offs - offs[0]


def parts(column: pa.Array, size: int = _SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``utf8`` of consecutive runs of texts of about ``size`` bytes (a longer text is a run of
    its own), so that what is derived from the words never covers a whole batch at a time."""
    body, offs = utf8(column)
    at, end = 0, len(offs) - 1
    while at < end:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield body[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def words(body: np.ndarray, offs: np.ndarray,
          separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and hashes of all words, and the number of words before each text
    (``len(offs)`` entries). ``separators`` flags the byte values between words."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    solid = ~separators[body]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offs[:-1][offs[:-1] < len(body)]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
            part = body[low:ends[to - 1]]
            up, down = _Powers.upto(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
    return starts, mix(hashes), np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``width`` words (across text borders too: the caller cuts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, width):
            out = out * np.uint64(_WORD_MULT) + hashes[j:j + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, distinct from every shingle by its length."""
    value = len(hashes)
    for h in hashes.tolist():
        value = (value * _WORD_MULT + h) & _MASK
    return mix(np.array([value ^ (len(hashes) << 56)], np.uint64))[0]


def inner_shingles(body: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shingle hashes of all texts, repeats included, none across a text border."""
    _, hashes, upto = words(body, offs)
    runs = shingles(hashes)
    end = np.repeat(upto[1:], np.diff(upto))[:len(runs)]
    return runs[np.arange(SHINGLE, len(runs) + SHINGLE) <= end]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Yield per text its sorted distinct shingle hashes (fewer words than a shingle: the
    whole sequence as one; no word: empty)."""
    for body, offs in parts(column):
        _, hashes, upto = words(body, offs)
        runs = shingles(hashes)
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(runs[a:b - SHINGLE + 1])
            elif b > a:
                yield np.array([sequence_hash(hashes[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
