"""64-bit hashes of words and of runs of words, for whole batches of texts at once, in numpy.

Bytes, and then words, are digits of a polynomial modulo 2 ** 64; prefix sums give the value of any run by one
subtraction, whatever its length and place.  Values are mixed at the end.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 21
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(n: int, base: int) -> np.ndarray:
    return _powers(max(22, (n - 1).bit_length()), base)[:n]


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for arrays of starts and ends."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), BASE), out=total[1:], dtype=U)
    return mix((total[end] - total[start]) * powers(len(values) + 1, pow(BASE, -1, 1 << 64))[start])


@lru_cache(maxsize=2)
def _digits(lower: bool) -> np.ndarray:
    digits = mix(np.arange(1, 257, dtype=U) * U(BASE))
    if lower:
        digits[65:91] = digits[97:123]
    return digits


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data``, ``hash``; those of text i are ``first[i]:first[i + 1]``.

    ``hashed=False`` leaves the hashes out.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        ink = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)  # whether the byte before belongs to the same word, if this one is a word's
        before[1:] = ink
        before[offsets] = False
        self.start = np.flatnonzero(ink & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = ink
        after[offsets] = False
        self.end = np.flatnonzero(ink & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.ink = ink
        if hashed:
            self.hash = runs(_digits(lower)[data], self.start, self.end) if len(data) else np.zeros(0, U)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def strings(self, lower: bool = False) -> pa.LargeBinaryArray:
        """The words themselves, A-Z lower-cased if asked."""
        ink = self.data[self.ink]
        if lower:
            ink = np.where((ink >= 65) & (ink <= 90), ink + np.uint8(32), ink)
        ends = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(ink)])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Text of each word, and its place in it."""
        text = np.repeat(np.arange(len(self.first) - 1), self.counts)
        return text, np.arange(len(self.start)) - self.first[text]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text, or one row."""
    sizes = batch.column(text).cast(pa.large_binary())
    ends = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()])
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, until - at)
        at = until
