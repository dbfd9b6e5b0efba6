"""Packing token pieces into sequences by exact complements, then best fit.

Only the histogram of piece lengths decides how lengths combine, and it has at most
``capacity`` entries whatever the corpus. The plan therefore is made from those counts
in one place: a sequence's gap is filled exactly by one, two or three lengths still
available, as often as their counts allow; what no exact sum completes goes by best
fit, which also takes the last of the exact fills back where they leave it short of
small pieces. Pieces then look up their place by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, number_rows
from sparkloom.llm.tokens import byte_level

Pattern = tuple[tuple[int, ...], int]
#: Places at which the list of exact fills may end for best fit to take over.
ENDS = 32


class _Sums:
    """Exact complements of a gap: an index of the pair sums of the lengths there are.

    ``left`` is shared with the plan. Counts only fall, so a pair or triple that could not
    be served once is never looked at again. Pairs of like lengths come first: they leave
    the short pieces, which fill small gaps, for later.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left, kinds = left, np.flatnonzero(left)
        i, j = np.triu_indices(len(kinds))
        small, sums = kinds[i], kinds[i] + kinds[j]
        fits = sums < len(left)
        order = np.lexsort((-small[fits], sums[fits]))
        self.small = small[fits][order]
        at = np.searchsorted(sums[fits][order], np.arange(len(left) + 1))
        self.next, self.end = at[:-1].copy(), at[1:]
        self.kinds, self.largest = kinds[::-1], np.zeros(len(left), np.int64)

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] > 0 else None

    def two(self, total: int) -> tuple[int, ...] | None:
        while self.next[total] < self.end[total]:
            small = int(self.small[self.next[total]])
            large = total - small
            if self.left[small] > (small == large) and self.left[large] > 0:
                return large, small
            self.next[total] += 1
        return None

    def three(self, total: int) -> tuple[int, ...] | None:
        while self.largest[total] < len(self.kinds):
            large = int(self.kinds[self.largest[total]])
            if self.left[large] > 0 and large < total:
                # With one piece of it set aside; the pair's place in the index must not move for that.
                place = self.next[total - large]
                self.left[large] -= 1
                rest = self.two(total - large)
                self.left[large] += 1
                self.next[total - large] = place
                if rest:
                    return large, *rest
            self.largest[total] += 1
        return None


def _take(left: np.ndarray, lengths: tuple[int, ...]) -> Pattern:
    """The lengths as one sequence, as often as the counts allow."""
    kinds, need = np.unique(lengths, return_counts=True)
    times = int((left[kinds] // need).min())
    left[kinds] -= need * times
    return lengths, times


def exact_fills(left: np.ndarray) -> list[Pattern]:
    """Sequences without a gap, taken from ``left``: with one other piece for all lengths
    first, then with two, then with three, so that long sums don't use up short pieces."""
    capacity = len(left) - 1
    patterns = [_take(left, (capacity,))] if left[capacity] else []
    for parts in ("one", "two", "three"):
        complement = getattr(_Sums(left), parts)
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                left[length] -= 1
                fill = complement(capacity - length)
                left[length] += 1
                if fill is None:
                    break
                patterns.append(_take(left, (length, *fill)))
    return patterns


def best_fit(left: np.ndarray) -> list[Pattern]:
    """Longest piece first, each into the open sequence with the smallest gap that holds it.

    Sequences alike are kept as one pattern with its number. A gap that takes a piece
    and still holds another of that length is then the smallest one, so it takes as many
    as fit before the next. Uses ``left`` up.
    """
    capacity = len(left) - 1
    gaps: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, left[length] = int(left[length]), 0
        while n:
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                gap, lengths, times = capacity, (), n
            else:
                lengths, times = gaps[gap].pop()
            fit = gap // length
            full = min(times, n // fit)
            n -= full * fit
            if full:
                gaps[gap - fit * length].append((lengths + (length,) * fit, full))
            times -= full
            if times and n:
                gaps[gap - n * length].append((lengths + (length,) * n, 1))
                n, times = 0, times - 1
            if times and lengths:
                gaps[gap].append((lengths, times))
    return [pattern for alike in gaps for pattern in alike]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of lengths and how many sequences follow each.

    The exact fills, as many of them in order as leave best fit so many short pieces that
    the whole needs no more sequences than best fit alone would; then best fit. Every
    pattern uses up at least one length, so their number is bounded by the capacity and
    not by the corpus.
    """
    whole = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        whole[length] = n
    exact, size = exact_fills(whole.copy()), lambda patterns: sum(times for _, times in patterns)
    most = size(best_fit(whole.copy()))
    for end in sorted({len(exact) * i // ENDS for i in range(ENDS + 1)}, reverse=True):
        left = whole.copy()
        for lengths, times in exact[:end]:
            np.subtract.at(left, list(lengths), times)
        found = exact[:end] + best_fit(left)
        if size(found) <= most:
            return found
    raise AssertionError("best fit alone needs no more sequences than itself")


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, last, sequence, offset): pieces of a length numbered
    ``first`` to ``last`` go to consecutive sequences from ``sequence`` at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            used[length] = first + times
            rows.append((length, first, first + times - 1, sequence, offset))
            offset += length
        sequence += times
    return rows


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids, by the byte-level ``vocabulary``, end with ``end_id``; a null or
    empty text is that id alone. Texts are read whole, however long. Only documents of
    more than ``capacity`` ids are cut: the first piece takes the rest, the others are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level(vocabulary).encode
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [], [])
            for row, text in enumerate(batch.column(1)):
                ids = np.concatenate([np.frombuffer(encode(text.as_py()), np.uint16).astype("<u4"), end])
                n, data, at = len(ids), ids.tobytes(), 0
                piece = 0
                while at < n:
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    part = data[4 * at : 4 * (at + length)]
                    for values, value in zip(out, (row, piece, at, length, zlib.crc32(part), part), strict=True):
                        values.append(value)
                    at += length
                    piece += 1
            columns = [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece its ``sequence_id`` and its ``offset`` in that sequence.

    ``cut`` has the columns of :func:`pieces`. Repeated rows are packed as often as
    they come; an empty table packs into nothing.
    """
    spark = cut.sparkSession
    stored = materialize(cut, "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(slots(plan(counts, capacity)), "s_length long, s_first long, s_last long, s_sequence long, s_offset long")
    numbered = number_rows(stored, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_n")
    # The places number at most a few per length and pattern: a bound by the capacity.
    inside = (F.col("length") == F.col("s_length")) & F.col("_n").between(F.col("s_first"), F.col("s_last"))
    return numbered.join(F.broadcast(places), inside).select(
        *cut.columns, (F.col("s_sequence") + F.col("_n") - F.col("s_first")).alias("sequence_id"), F.col("s_offset").alias("offset")
    )
