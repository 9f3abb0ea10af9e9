"""Word and n-gram hashes of whole Arrow text columns in numpy.

A word is hashed as a polynomial of its bytes, an n-gram as a polynomial of its word hashes,
both modulo 2**64 with odd bases: prefix sums give every word and every window by one
subtraction and one multiplication with an inverse power. A finaliser mixes the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from contrastry.llm.batches import text_offsets

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

#: Fixed value: bytes between words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Fixed value: separators of plain words, which are runs of ASCII letters, digits and all non-ASCII characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
AS_IS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWERED = AS_IS.copy()
LOWERED[ord("A"):ord("Z") + 1] = AS_IS[ord("a"):ord("z") + 1]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def polynomial(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(inverse(base), len(sums))[start]


class Words:
    """Words of a text column: byte ranges in ``data``, hashes, and the first word of each row (``first[i]`` to ``first[i + 1]``)."""

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR):
        offsets = text_offsets(column)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~separator[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(self.data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = ranges((LOWERED if lower else AS_IS)[self.data], BYTE_BASE)
        self.hash = mix(polynomial(sums, BYTE_BASE, self.start, self.end) + U(1))
        self._sums: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ``size - 1`` of a row run over its end."""
        count = len(self.hash) - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(count)
        return self.spans(at, at + size)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words ``start`` to ``end``; the number of words takes part."""
        if self._sums is None:
            self._sums = ranges(self.hash, WORD_BASE)
        return mix(polynomial(self._sums, WORD_BASE, start, end) + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
