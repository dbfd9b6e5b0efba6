import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import kpi, ranges, relational


def test_running_sums_and_rows_before(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "a", None, "b"]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = ranges.running(df, ["g"], [-F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, {"before": F.col("v")}).collect()
    for g in ("a", "b", None):
        total, last = 0, None
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: -r["i"])
        for n, r in enumerate(mine, 1):
            total += r["v"]
            assert (r["s"], r["n"], r["before"]) == (total, n, last)
            last = r["v"]
    assert sum(r["v"] for r in got) == sum(r[2] for r in rows) and len(got) == 500
    assert ranges.running(df.limit(0), [], [F.col("i")], {"s": F.col("v")}).count() == 0


def test_percentiles_by_rank(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, 1.5, rng.random() * 10, -3.0])) for _ in range(2000)] + [("none", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["g"]: r for r in kpi.interp_percentiles(df, "v", shares, by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [v for h, v in rows if h == g and v is not None]
        assert got[g]["n"] == len(values)
        for name, p in shares.items():
            assert got[g][name] == (pytest.approx(float(np.percentile(values, 100 * p))) if values else None)
    whole = kpi.interp_percentiles(df, "v", shares, F.col("v") > 0).first()
    assert whole["p95"] == pytest.approx(float(np.percentile([v for _, v in rows if v is not None and v > 0], 95)))
    empty = kpi.interp_percentiles(df.limit(0), "v", {"p": 0.5}).first()
    assert (empty["p"], empty["n"]) == (None, 0)
    assert kpi.interp_percentiles(df.limit(0), "v", {"p": 0.5}, by=["g"]).count() == 0


def test_ids_of_one_hot_version(spark):
    base = spark.createDataFrame([("1.1", "k3", 10, "old")], "version string, k string, id int, v string")
    incoming = spark.createDataFrame([("1.1", f"k{i}", "new") for i in range(300)] + [("1.0", "x", "new")], "version string, k string, v string")
    got = {(r["version"], r["k"]): r["id"] for r in relational.upsert_with_ids(base, incoming, "version", "k", "id").collect()}
    fresh = sorted(k for k in got if k != ("1.1", "k3"))
    assert got[("1.1", "k3")] == 10 and [got[k] for k in fresh] == list(range(11, 11 + 300))
