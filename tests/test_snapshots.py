import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import incremental, snapshots

ROWS = "kind string, id long, v string, on boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_readers_keep_their_folders_while_a_version_is_republished(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(spark.range(1000), path, "1.1")
    old = snapshots.read_version(spark, path, "1.1")
    assert old.count() == 1000
    snapshots.publish(spark.range(10), path, "1.1")
    assert old.agg(F.sum("id")).first()[0] == 499500  # the plan made before reads on
    assert snapshots.read_version(spark, path, "1.1").count() == 10
    assert snapshots.sweep(spark, path, timedelta(hours=1)) == [] and old.count() == 1000
    assert len(snapshots.sweep(spark, path, timedelta(0))) == 1 and len(os.listdir(f"{path}/data")) == 1
    assert snapshots.read_version(spark, path, "1.1").count() == 10


def test_retention_deletes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in ("1.8", "1.9", "1.10", "1.11"):
        snapshots.publish(spark.range(3), path, v)
    spark.range(1).write.parquet(f"{path}/data/failed")  # left by a publication that did not end
    assert snapshots.retire(spark, path, 2, ["1.8"]) == ["1.9"]
    assert list(snapshots.live(spark, path)) == ["1.8", "1.10", "1.11"] and len(os.listdir(f"{path}/data")) == 5
    with pytest.raises(ValueError, match="no version 1.9"):
        snapshots.read_version(spark, path, "1.9")
    gone = snapshots.sweep(spark, path, timedelta(0))
    assert len(gone) == 2 and "data/failed" in gone and len(os.listdir(f"{path}/data")) == 3
    assert snapshots.retire(spark, path, 2, ["1.8"]) == [] and snapshots.retire(spark, path, 0) == ["1.8", "1.10", "1.11"]
    assert snapshots.live(spark, path) == {} and len(snapshots.sweep(spark, path, timedelta(0))) == 3
    snapshots.publish(spark.range(0), path, "1.9")
    assert snapshots.read_version(spark, path, "1.9").count() == 0


def test_refresh_writes_changes_only(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["kind", "id"]
    base = [("a", 1, "x", True), ("a", 2, "y", True), ("a", 3, None, True), ("b", 1, "z", True), ("c", 9, "kept", True), ("a", None, "n", True)]
    incremental.publish(frame(spark, base), path, "2.1", keys)
    first = snapshots.live(spark, path)["2.1"]["folders"]
    incoming = frame(spark, [("a", 1, "x", True), ("a", 2, "Y", True), ("a", 4, "new", True), ("a", None, "n", True), ("c", 9, "ignored", True), ("b", 2, "p", True), ("b", 2, "q", True)])
    counts = incremental.refresh(spark, path, "2.1", incoming, keys, "kind", ["a", "b"], {"on": F.lit(False)})
    assert counts == {"inserted": 2, "updated": 1, "missing": 2}
    got = content(incremental.read(spark, path, "2.1", keys))
    assert [r for r in got if r[:2] != ("b", 2)] == sorted([("a", 1, "x", True), ("a", 2, "Y", True), ("a", 3, None, False), ("a", 4, "new", True), ("a", None, "n", True), ("b", 1, "z", False), ("c", 9, "kept", True)], key=str)
    assert sum(r[:2] == ("b", 2) for r in got) == 1
    folders = snapshots.live(spark, path)["2.1"]["folders"]
    assert folders[:1] == first and spark.read.parquet(f"{path}/{folders[1]}").count() == 5
    assert incremental.refresh(spark, path, "2.1", incoming, keys, "kind", ["a", "b"], {"on": F.lit(False)}) == {}
    assert snapshots.live(spark, path)["2.1"]["folders"] == folders
    assert incremental.refresh(spark, path, "2.1", frame(spark, []), keys, "kind", ["b"], "drop") == {"missing": 2}
    assert {r[0] for r in content(incremental.read(spark, path, "2.1", keys))} == {"a", "c"}
    incremental.refresh(spark, path, "2.1", frame(spark, [("b", 1, "back", True)]), keys, "kind", ["b"])
    rows = content(incremental.read(spark, path, "2.1", keys))
    assert ("b", 1, "back", True) in rows and len(snapshots.live(spark, path)["2.1"]["folders"]) == 4
    incremental.compact(spark, path, "2.1", keys)
    assert len(snapshots.live(spark, path)["2.1"]["folders"]) == 1 and content(incremental.read(spark, path, "2.1", keys)) == rows
    with pytest.raises(ValueError, match="no version"):
        incremental.refresh(spark, path, "2.2", incoming, keys, "kind", ["a"])
