"""Words of whole Arrow columns, cut byte-wise with numpy.

Separators are ASCII, so a cut never falls inside a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Lower-cased words in order; where each starts in ``data``; the texts' bounds there."""

    words: pa.StringArray
    starts: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def documents(self) -> np.ndarray:
        """Number of each word's text."""
        return np.searchsorted(self.bounds, self.starts, "right") - 1

    def per_document(self) -> np.ndarray:
        """How many words each text has."""
        at = np.searchsorted(self.starts, self.bounds)
        return np.diff(at)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes belong to words: those outside all (first, last) ranges."""
    word = np.ones(256, bool)
    for first, last in ranges:
        word[first : last + 1] = False
    return word


def cut(texts: pa.Array, word: np.ndarray) -> Words:
    """Words of each text; null and empty texts have none."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = (bounds - bounds[0]).astype(np.int64)
    inside = word[raw]
    filled = bounds[1:] > bounds[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[:-1][filled]
    first[edge] = inside[edge]
    edge = bounds[1:][filled] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=ends[1:])
    words = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[raw[inside]])])
    return Words(words, starts, bounds, raw)


def runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts with at most ``most`` bytes, or of one longer text."""
    if not len(texts):
        return
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield begin, end
        begin, before = end, int(sizes[end - 1])
