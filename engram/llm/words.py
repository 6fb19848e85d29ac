"""Words and word hashes of many texts at once, on the UTF-8 bytes that Arrow hands over.

A word is a maximal run of word bytes. Its 64-bit hash is a sum of random byte values times powers of an odd base,
taken from one running sum over all bytes, so no Python code runs per word. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FOLD = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of texts handled in one go; longer texts are handled alone.
CHUNK_BYTES = 1 << 21


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, ends included."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


#: Everything but blanks, tabs, line ends, form feeds and vertical tabs.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters, digits, and every character beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text begins and the last ends; null is an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


@dataclass
class Words:
    """Words of ``n`` texts: text index, first byte, byte after the last."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def sums(self) -> np.ndarray:
        values = _VALUE[self.data] * _power(len(self.data) + 1)[0][: len(self.data)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def hashes(self, sums: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        sums = self.sums() if sums is None else sums
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mix((sums[end] - sums[self.start]) * _power(len(self.data) + 1)[1][self.start])


def split(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[filled] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, np.searchsorted(offsets, start, "right") - 1, start, end)


def chunks(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words) of consecutive runs of texts of about CHUNK_BYTES."""
    data, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        high = min(high, n)
        part = offsets[low : high + 1]
        yield low, split(data[part[0] : part[-1]], part - part[0], is_word)
        low = high


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; across text borders too, which the caller must leave out."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - size + 1] + np.uint64(size)
    for k in range(1, size):
        out = mix(out * _FOLD + h[k : len(h) - size + 1 + k])
    return out


def windows(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``size`` words inside one text."""
    hashed = window_hashes(h, size)
    inside = words.doc[: len(hashed)] == words.doc[size - 1 :][: len(hashed)]
    return np.flatnonzero(inside), hashed[inside]


def shingles(words: Words, h: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a text of fewer words is one shingle, without words none."""
    first, hashed = windows(words, h, size)
    cut = np.searchsorted(words.doc[first], np.arange(words.n + 1))
    bounds = words.bounds()
    out = []
    for i in range(words.n):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(hashed[cut[i] : cut[i + 1]]))
        else:
            own = h[bounds[i] : bounds[i + 1]]
            out.append(window_hashes(own, len(own)) if len(own) else own)
    return out
