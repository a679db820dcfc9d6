"""Texts as byte arrays: word spans, word and n-gram hashes, sliding minima. NumPy only, whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer text is handled alone and whole.
PIECE_BYTES = 1 << 20

_WHITE = np.ones(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Word bytes: ``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
WORDS = {"white": _WHITE, "alnum": _ALNUM}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: One fixed 64-bit value per byte.
VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most PIECE_BYTES of text, or one row."""
    if column not in batch.schema.names or not batch.num_rows:
        yield batch
        return
    sizes = np.diff(offsets(batch.column(column)))
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > PIECE_BYTES:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    yield batch.slice(lo)


def _binary(column: pa.Array) -> pa.Array:
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary())


def offsets(column: pa.Array) -> np.ndarray:
    column = _binary(column)
    kind = np.int32 if column.type == pa.binary() else np.int64
    raw = np.frombuffer(column.buffers()[1], kind) if column.buffers()[1] else np.zeros(1, kind)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one entry more than texts)."""
    column = _binary(column)
    at = offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


class Words:
    """Words of a text column: start, end (bytes), text number, 64-bit hash of the lower-cased word."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, kind: str = "white"):
        inside = WORDS[kind][buf]
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        cuts = at[:-1][at[:-1] < len(buf)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1
        #: Words before each text; one entry more than texts.
        self.first = np.searchsorted(self.text, np.arange(len(at)))
        self.hash = self._hashes(buf, inside)

    def _hashes(self, buf: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        values = VALUES[LOWER[buf[inside]]] * powers(int(sizes.max()))[place]
        return mix(np.add.reduceat(values, begins) + sizes.astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every n following entries (texts are not separated here)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= BASE
        out += hashes[i: len(hashes) - n + 1 + i]
    return mix(out + np.uint64(n))


def byte_grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n following bytes, by doubling."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    step, width, have = VALUES[buf], 1, None
    taken = 0
    power = BASE
    while True:
        if n & width:
            piece = step[taken: taken + m]
            have = piece.copy() if have is None else have * power + piece
            taken += width
        if width * 2 > n:
            return mix(have)
        size = len(step) - width
        step = step[:size] * power + step[width: width + size]
        width *= 2
        with np.errstate(over="ignore"):
            power = power * power + np.uint64(2)


def sliding(values: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every n following entries."""
    width, step = 1, values
    while width * 2 <= n:
        step = best(step[: len(step) - width], step[width:])
        width *= 2
    m = len(values) - n + 1
    return best(step[:m], step[n - width: n - width + m])
