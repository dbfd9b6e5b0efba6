"""Running sums and rows before, over groups of any size: sort by ranges, carry over range totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.snapshots import shared_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] | None = None, previous: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with running sums (the row itself included) and values of the row before, in order, within ``by``.

    Rows are dealt out by ranges of (by, order) and written down with their range. Per
    range and group there is one total; a range's first group takes what earlier ranges
    have of it, so at most one row for each range is sent to all. No window holds more
    rows than a range. ``order`` (ascending, nulls first) should tell the rows of a group
    apart; those alike stay in one range, in any order. ``by`` may be empty.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    parts, befores = [f"_s{i}" for i in range(len(sums))], [f"_v{i}" for i in range(len(previous))]
    ranks = [f"_o{i}" for i in range(len(order))]
    values = [c.alias(n) for c, n in zip([*sums.values(), *previous.values(), *order], [*parts, *befores, *ranks], strict=True)]
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.select("*", *values).repartitionByRange(count, *by, *ranks).withColumn("_p", F.spark_partition_id()), "ranges")
    last = F.max_by(F.struct(*[F.col(b) for b in befores], F.lit(True).alias("_is")), F.struct(*ranks)).alias("_last")
    totals = dealt.groupBy(*by, "_p").agg(last, *[F.sum(p).alias(p) for p in parts])
    line = Window.partitionBy(*by).orderBy("_p")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_p").alias("_bp"), F.lag("_last").over(line).alias("_before"), *[F.sum(p).over(earlier).alias(f"_c{p}") for p in parts])
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)], F.col("_p") == F.col("_bp"))
    within = Window.partitionBy(*by, "_p").orderBy(*ranks)
    here = dealt.withColumns({f"_r{p}": F.sum(p).over(within.rowsBetween(Window.unboundedPreceding, 0)) for p in parts} | {"_lag": F.lag(F.struct(*[F.col(b) for b in befores], F.lit(True).alias("_is"))).over(within)})
    out = here.join(F.broadcast(carried.filter(F.col("_before").isNotNull())), same, "left")
    added = [(F.col(f"_r{p}") + F.coalesce(F.col(f"_c{p}"), F.lit(0))).alias(n) for p, n in zip(parts, sums, strict=True)]
    return out.select(*df.columns, *added, *[F.coalesce("_lag", "_before")[b].alias(n) for b, n in zip(befores, previous, strict=True)])
