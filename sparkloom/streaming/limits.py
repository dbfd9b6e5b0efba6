"""Fixed-window rate limits whose window starts at the first event, batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def _walk(times: np.ndarray, width: int, start: int, n: int) -> tuple[np.ndarray, int, int]:
    """Number of each event in its window; window start and number at the end."""
    seen = np.empty(len(times), np.int64)
    for i, t in enumerate(times.tolist()):
        if n == 0 or t - start >= width:
            start, n = t, 0
        n += 1
        seen[i] = n
    return seen, start, n


def fixed_window_limit(events: DataFrame, key: str, ts: str, tiebreak: str, limit: int, seconds: int) -> DataFrame:
    """``events`` with ``seen`` (number within its window) and ``allowed``.

    A key's window opens at its first event and at the first event ``seconds`` or more
    after the last opening; refused events count too. A key's events are walked in order
    batch by batch, holding two numbers, so a key with any share of the rows takes no
    more memory than others. Rows of a null key form one key; a null time raises.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = object(), 0, 0
        for batch in batches:
            codes, _ = pd.factorize(batch[key], use_na_sentinel=False)
            edges = np.flatnonzero(np.diff(codes)) + 1
            seen = []
            for part in np.split(np.arange(len(batch)), edges):
                if not len(part):
                    continue
                here = batch[key].iloc[part[0]]
                if not (here == last or (pd.isna(here) and last is None)):
                    last, n = None if pd.isna(here) else here, 0
                numbers, start, n = _walk(batch["_us"].to_numpy()[part], seconds * 1_000_000, start, n)
                seen.append(numbers)
            out = batch.drop(columns="_us")
            out["seen"] = np.concatenate(seen) if seen else np.empty(0, np.int64)
            yield out

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ordered = events.withColumn("_us", micros).repartition(key).sortWithinPartitions(key, "_us", tiebreak)
    schema = StructType([*events.schema.fields, StructField("seen", LongType())])
    return ordered.mapInPandas(work, schema).withColumn("allowed", F.col("seen") <= limit)


class _OpenWindow(StatefulProcessor):
    """The open window of one key: its start and number of events, until the watermark has passed it."""

    def __init__(self, key: str, tiebreak: str, limit: int, width: int) -> None:
        self.key, self.tiebreak, self.limit, self.width = key, tiebreak, limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, n = self.window.get() if self.window.exists() else (0, 0)
        before = start if n else None
        events = pd.concat([r[["us__", self.tiebreak]] for r in rows]).sort_values(["us__", self.tiebreak])
        seen, start, n = _walk(events["us__"].to_numpy(), self.width, start, n)
        self.window.update((start, n))
        if before != start:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(start))
        yield pd.DataFrame({self.key: [key[0]] * len(events), self.tiebreak: events[self.tiebreak].to_numpy(), "seen": seen, "allowed": seen <= self.limit})

    def _end(self, start: int) -> int:
        return -(-(start + self.width) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # No event of this window can come any more, and the next one opens a new window.
        if self.window.exists() and self._end(self.window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, ts: str, tiebreak: str, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same over a stream, with the open window of each key as state.

    Within a micro-batch a key's events are taken in order of time. Returns key,
    tiebreak, seen, allowed. Events may come ``late`` by so much; the watermark drops
    others, and a key's state goes once its window has ended before the watermark, so
    state grows with the keys of a window's length, not with all keys ever seen. Sets the
    session's state store to RocksDB, which timers need.
    """
    use_rocksdb(events.sparkSession)
    kinds = dict(events.dtypes)  # processors get no names that start with an underscore
    time = F.col(ts).cast("timestamp")
    timed = events.select(key, tiebreak, time.alias("time__"), F.unix_micros(time).alias("us__")).withWatermark("time__", late)
    schema = f"{key} {kinds[key]}, {tiebreak} {kinds[tiebreak]}, seen long, allowed boolean"
    return timed.groupBy(key).transformWithStateInPandas(_OpenWindow(key, tiebreak, limit, seconds * 1_000_000), schema, "append", "eventtime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
