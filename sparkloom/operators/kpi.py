"""Indicators over event tables: means, percentiles, funnels, cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranges import running


def filtered_mean(df: DataFrame, value: Column, where: Column | None = None, scale: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Mean (null if nothing counts) and number of the values that ``where`` lets through."""
    kept = value if where is None else F.when(where, value)
    return df.groupBy(*by).agg((F.avg(kept) * scale).alias("mean"), F.count(kept).alias("n"))


def interp_percentiles(df: DataFrame, value: str, shares: dict[str, float], where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each name in ``shares``, and the number of values.

    Equal values are counted before they are shuffled, and the counts summed up over
    ranges of values; only the rows at the two ranks around each percentile are gathered.
    A group may have any number of distinct values. Null without values.
    """
    kept = F.col(value) if where is None else F.when(where, F.col(value))
    values = df.select(*by, kept.cast("double").alias("_v"))
    totals = values.groupBy(*by).agg(F.count("_v").alias("n"))
    counts = values.filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, by, [F.col("_v")], {"_upto": F.col("_n")})
    group = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    sizes = totals.select(*group, F.col("n").alias("_size"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)], F.lit(True))
    rank = lambda p: F.lit(p) * (F.col("_size") - 1)
    ends = {f"_{end.__name__}{i}": end(rank(p)).cast("long") for i, p in enumerate(shares.values()) for end in (F.floor, F.ceil)}
    holds = {n: (F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")) for n, r in ends.items()}
    ranked = placed.join(sizes, same) if by else placed.withColumn("_size", F.lit(totals.first()["n"]))
    near = ranked.filter(reduce(lambda a, b: a | b, holds.values())) if holds else ranked.limit(0)
    found = near.groupBy(*by).agg(F.first("_size").alias("_size"), *[F.max(F.when(h, F.col("_v"))).alias(n) for n, h in holds.items()])
    between = [(F.col(f"_floor{i}") + (F.col(f"_ceil{i}") - F.col(f"_floor{i}")) * (rank(p) - F.floor(rank(p)))).alias(name) for i, (name, p) in enumerate(shares.items())]
    picked = found.select(*group, *between)
    if not by:
        return summary(_p=picked.agg(*[F.max(n).alias(n) for n in shares]), _n=totals).select("_p.*", "_n.*")
    return totals.join(picked, same, "left").select(*by, *shares, "n")


def funnel(exposures: DataFrame, actions: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: exposed (rows), acted (action rows with an exposed key), percent (null if none exposed).

    Actions are counted, not keys that acted, so percent can exceed 100.
    """
    marked = exposures.groupBy(*on).agg(F.count(F.lit(1)).alias("_e")).withColumn("_a", F.lit(0).cast("long"))
    acted = actions.groupBy(*on).agg(F.count(F.lit(1)).alias("_a")).withColumn("_e", F.lit(0).cast("long"))
    by_key = marked.unionByName(acted).groupBy(*on).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    sums = by_key.agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("exposed"), F.coalesce(F.sum(F.when(F.col("_e") > 0, F.col("_a"))), F.lit(0)).alias("acted"))
    return sums.withColumn("percent", F.when(F.col("exposed") > 0, F.col("acted") / F.col("exposed") * 100))


def first_touch(df: DataFrame, key: str, ts: str, where: Column, name: str = "first_ts") -> DataFrame:
    """Earliest time per key of the rows that ``where`` lets through."""
    return df.filter(where).groupBy(key).agg(F.min(ts).alias(name))


def converted_within(events: DataFrame, key: str, ts: str, first: Column, action: Column, hours: Sequence[int], now: Column) -> DataFrame:
    """Per window length: keys old enough (eligible), those that acted in time, percent.

    A key acts in time if an action falls into the closed window from its first touch.
    One shuffle for the first touches and one join serve all windows.
    """
    touched = first_touch(events, key, ts, first)
    acts = events.filter(action).select(key, F.col(ts).alias("_ts"))
    late = F.col("_ts") - F.col("first_ts")
    nearest = touched.join(acts, key, "left").groupBy(key, "first_ts").agg(F.min(F.when(late >= F.expr("INTERVAL 0 SECONDS"), late)).alias("_late"))
    windows = F.array(*[F.lit(h) for h in hours])
    each = nearest.select(F.explode(windows).alias("hours"), "first_ts", "_late").withColumn("_w", F.make_dt_interval(F.lit(0), F.col("hours")))
    eligible = each.filter(now - F.col("first_ts") >= F.col("_w"))
    done = F.coalesce(F.col("_late") <= F.col("_w"), F.lit(False)).cast("long")
    return eligible.groupBy("hours").agg(F.count(F.lit(1)).alias("eligible"), F.sum(done).alias("converted"), (F.avg(done) * 100).alias("percent"))


def summary(**metrics: DataFrame) -> DataFrame:
    """One row with a struct for each named one-row frame; joined by a union and one aggregation of a handful of rows."""
    rows = [m.select(*[F.struct(*m.columns).alias(n) if n == name else F.lit(None).cast(other.schema).alias(n) for n, other in metrics.items()]) for name, m in metrics.items()]
    return reduce(DataFrame.unionAll, rows).agg(*[F.first(n, ignorenulls=True).alias(n) for n in metrics])
