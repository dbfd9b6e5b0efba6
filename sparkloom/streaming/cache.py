"""Answers that can be had again for a time, batch and stream.

Rows with an answer put it in the cache of their key; rows without one ask. An answer
serves for ``seconds`` from when it was put, or until the next one is put.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming.limits import use_rocksdb


def cached_answers(rows: DataFrame, key: str, ts: str, tiebreak: str, answer: str, seconds: int) -> DataFrame:
    """key, tiebreak, cached: for every row that asks, the answer that serves then, or null.

    Rows of a key are taken in order of time and ``tiebreak``.
    """
    before = Window.partitionBy(key).orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = F.last(F.when(F.col(answer).isNotNull(), F.struct(answer, ts)), ignorenulls=True).over(before)
    known = rows.withColumn("_put", put).filter(F.col(answer).isNull())
    alive = F.unix_micros(F.col(ts).cast("timestamp")) < F.unix_micros(F.col(f"_put.{ts}").cast("timestamp")) + seconds * 1_000_000
    return known.select(key, tiebreak, F.when(alive, F.col(f"_put.{answer}")).alias("cached"))


class _Answer(StatefulProcessor):
    """The answer of one key and when it was put, until the watermark has passed its time."""

    def __init__(self, key: str, tiebreak: str, width: int) -> None:
        self.key, self.tiebreak, self.width = key, tiebreak, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "answer string, at long")

    def _end(self, at: int) -> int:
        return -(-(at + self.width) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        answer, at = before = tuple(self.held.get()) if self.held.exists() else (None, 0)
        asked = []
        for us, tie, put in pd.concat(list(rows)).sort_values(["us__", self.tiebreak])[["us__", self.tiebreak, "answer__"]].itertuples(index=False):
            if put is not None:
                answer, at = put, us
            else:
                asked.append((tie, answer if answer is not None and us < at + self.width else None))
        if (answer, at) != before:
            if before[0] is not None:
                self.handle.deleteTimer(self._end(before[1]))
            self.held.update((answer, at))
            self.handle.registerTimer(self._end(at))
        if asked:
            yield pd.DataFrame({self.key: [key[0]] * len(asked), self.tiebreak: [t for t, _ in asked], "cached": pd.Series([c for _, c in asked], dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists() and self._end(self.held.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_answer_stream(rows: DataFrame, key: str, ts: str, tiebreak: str, answer: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same over a stream; a key's answer leaves the state once the watermark has passed its time.

    Rows may come ``late`` by so much; the watermark drops others. Sets the session's
    state store to RocksDB, which timers need.
    """
    use_rocksdb(rows.sparkSession)
    kinds = dict(rows.dtypes)
    time = F.col(ts).cast("timestamp")
    timed = rows.select(key, tiebreak, F.col(answer).cast("string").alias("answer__"), time.alias("time__"), F.unix_micros(time).alias("us__")).withWatermark("time__", late)
    return timed.groupBy(key).transformWithStateInPandas(_Answer(key, tiebreak, seconds * 1_000_000), f"{key} {kinds[key]}, {tiebreak} {kinds[tiebreak]}, cached string", "append", "eventtime")
