from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.sources import events


def test_rows_of_logs(spark):
    rows = spark.createDataFrame([("s", 9_999, None), ("t", 10_000, datetime(2026, 1, 1)), ("u", None, None)], "session_id string, latency_ms int, created_at timestamp")
    got = {r["session_id"]: r for r in events.log_rows(rows, events.CHAT_LOG, "created_at").collect()}
    assert [got[s]["cold_start"] for s in "stu"] == [False, True, None]
    assert got["t"]["created_at"] == datetime(2026, 1, 1) and got["s"]["created_at"].year > 2025 and got["s"]["answer"] is None
    clicks = events.log_rows(rows.select("session_id"), events.LINK_CLICKS, "clicked_at")
    assert clicks.columns == ["session_id", "chat_log_id", "target_page", "clicked_at"] and clicks.filter("clicked_at is null").count() == 0


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = events.log_rows(spark.range(5).select(F.col("id").alias("chat_log_id")), events.LINK_CLICKS, "clicked_at")
    assert events.append_batch(rows, path, "web", 0) and not events.append_batch(rows, path, "web", 0)
    assert events.append_batch(rows, path, "web", 1) and events.append_batch(rows, path, "app", 0)
    assert events.read_log(spark, path, events.LINK_CLICKS).groupBy("source", "batch").count().count() == 3
    (tmp_path / "log/source=web/batch=1/_SUCCESS").unlink()  # an attempt that did not end
    assert events.append_batch(rows.limit(2), path, "web", 1)
    assert events.read_log(spark, path, events.LINK_CLICKS).count() == 12
    with pytest.raises(ValueError, match="source"):
        events.append_batch(rows, path, "../x", 0)


def test_a_stream_run_again_without_its_checkpoint_adds_nothing(spark, tmp_path):
    for n in range(2):
        spark.range(10 * n, 10 * n + 10).select(F.col("id").alias("chat_log_id")).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    path = str(tmp_path / "log")
    for attempt in ("one", "two"):
        stream = spark.readStream.schema("chat_log_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = events.append_stream(events.log_rows(stream, events.LINK_CLICKS, "clicked_at"), path, "web", str(tmp_path / attempt)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        log = events.read_log(spark, path, events.LINK_CLICKS)
        assert log.count() == 20 and log.select("chat_log_id").distinct().count() == 20 and log.select("batch").distinct().count() == 2


def test_first_rows_in_korean_order(spark):
    rows = [(1, 2, "나"), (1, 1, "다"), (2, 1, "가"), (3, 1, "b"), (4, 1, "A"), (5, 1, "a"), (6, 1, "ä"), (7, 1, None)]
    first = relational.keep_first(spark.createDataFrame(rows, "k int, n int, name string"), ["k"], [F.col("n")])
    got = relational.placed(first, [F.collate("name", "ko"), F.col("k")], "place").orderBy("place").collect()
    assert [r["name"] for r in got] == [None, "가", "다", "a", "A", "ä", "b"]
