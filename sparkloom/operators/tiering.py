"""Tiers by gaps between scores, as running sums over sorted ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranges import running

LABELS = ("OP", "S", "A", "B", "C")


def gap_tiers(df: DataFrame, score: str, ordinal: str, by: Sequence[str] = (), labels: Sequence[str] = LABELS, factor: float = 1.3, out: str = "tier") -> DataFrame:
    """Label every row by how many wide gaps lie above its score.

    Scores are scaled to 0-100 within ``by`` and sorted downwards, ties by ``ordinal``.
    A gap wider than ``factor`` times the mean gap starts the next label; the last label
    takes the rest, and rows without a score. A single scored row gets the middle label.
    Rows are sorted by ranges, so ``by`` may be empty and a group of any size; scores are
    read three times, so pass a frame that is cheap to read or written down.
    """
    keys, groups = list(by), [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(keys)], F.lit(True))
    bounds = df.groupBy(*keys).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(score).alias("_count"))
    if keys:
        scored = df.join(bounds.select(*groups, "_low", "_high", "_count"), same)
    else:
        low, high, n = bounds.first()
        scored = df.withColumns({"_low": F.lit(low), "_high": F.lit(high), "_count": F.lit(n)})
    spread = F.col("_high") - F.col("_low")
    some = scored.filter(F.col(score).isNotNull()).withColumn("_n", F.when(spread == 0, F.lit(0.0)).otherwise((F.col(score) - F.col("_low")) / spread * 100))
    down = [-F.col("_n"), F.col(ordinal)]
    gaps = running(some, keys, down, previous={"_above": F.col("_n")})
    # The gaps of a group add up to its whole spread.
    mean = F.when(spread == 0, F.lit(0.0)).otherwise(F.lit(100.0)) / F.nullif(F.col("_count") - 1, F.lit(0))
    wide = F.coalesce(F.col("_above") - F.col("_n") > mean * factor, F.lit(False)).cast("int")
    levels = running(gaps.withColumn("_wide", wide), keys, down, {"_level": F.col("_wide")})
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.least(F.lit(len(labels) - 1), F.col("_level")).cast("int") + 1)
    tiers = levels.select(*df.columns, F.when(F.col("_count") == 1, F.lit(labels[len(labels) // 2])).otherwise(label).alias(out))
    return tiers.unionByName(df.filter(F.col(score).isNull()).withColumn(out, F.lit(labels[-1])))
