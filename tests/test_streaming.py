"""The streaming forms against the batch ones, and what they keep."""

import datetime as dt
import random

from sparkloom.streaming.cache import cached_answer_stream, cached_answers
from sparkloom.streaming.limits import fixed_window_limit, limit_stream

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, parts, schema, make):
    """Feeds the parts one file and one run each; rows out, and rows of state after each run."""
    kept = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str), kept


def test_limits_equal_batch_and_forget_closed_windows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randrange(60)}", START + dt.timedelta(seconds=rng.randrange(200))) for i in range(300)]
    rows += [(1000 + i, f"k{i}", START + dt.timedelta(seconds=3600 + i)) for i in range(3)] + [(2000, "k1", START + dt.timedelta(seconds=7200))]
    rows.sort(key=lambda r: r[2])
    parts = [rows[:150], rows[150:300], rows[300:303], rows[303:]]
    schema = "i long, k string, t timestamp"
    got, kept = run(spark, tmp_path, parts, schema, lambda s: limit_stream(s, "k", "t", "i", 2, 60))
    want = fixed_window_limit(spark.createDataFrame(rows, schema), "k", "t", "i", 2, 60).select("k", "i", "seen", "allowed")
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert max(kept) > 20 and kept[-1] <= 6, kept


def test_cached_answers_equal_batch_and_expire(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"q{rng.randrange(40)}", START + dt.timedelta(seconds=rng.randrange(300)), f"a{i}" if rng.random() < 0.4 else None) for i in range(300)]
    rows += [(1000, "q1", START + dt.timedelta(seconds=3600), "late"), (1001, "q1", START + dt.timedelta(seconds=3630), None), (1002, "q1", START + dt.timedelta(seconds=7200), None)]
    rows.sort(key=lambda r: (r[2], r[0]))
    parts = [rows[:100], rows[100:300], rows[300:301], rows[301:302], rows[302:]]
    schema = "i long, k string, t timestamp, a string"
    got, kept = run(spark, tmp_path, parts, schema, lambda s: cached_answer_stream(s, "k", "t", "i", "a", 60))
    want = sorted(map(tuple, cached_answers(spark.createDataFrame(rows, schema), "k", "t", "i", "a", 60).collect()), key=str)
    assert got == want and ("q1", 1001, "late") in got and ("q1", 1002, None) in got
    assert {c is None for _, _, c in want} == {True, False} and max(kept) > 10 and kept[-1] <= 4, kept
