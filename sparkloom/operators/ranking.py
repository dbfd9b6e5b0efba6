"""Top-N per group, group caps, quotas and last-N, all as windows with total orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group by ``order``, numbered from 1.

    ``order`` must be total, so at least one tiebreak column is asked for. Spark
    limits each map task to ``n`` rows of a group before the shuffle.
    """
    if n < 1:
        return df.withColumn(rank, F.lit(0)).limit(0)
    if len(order) < 2:
        raise ValueError("give a tiebreak: an order of one column is not total")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def capped_top_k(df: DataFrame, group: str, order: Sequence[Column], cap: int, k: int) -> DataFrame:
    """Best ``k`` rows overall, of which at most ``cap`` come from one group."""
    return top_n_per_group(df, [group], order, cap, "_cap").drop("_cap").orderBy(*order).limit(k)


def split_quota(total: int, names: Sequence[str]) -> dict[str, int]:
    """``total`` dealt out evenly; the remainder goes to the names that come first."""
    share, rest = divmod(total, len(names)) if names else (0, 0)
    return {name: share + (i < rest) for i, name in enumerate(names)}


def quota_union(df: DataFrame, kind: str, order: Sequence[Column], quotas: Mapping[str, int]) -> DataFrame:
    """For each kind its best rows up to its quota, in the order that the quotas name them."""
    names = list(quotas)
    quota = F.create_map(*[F.lit(x) for name in names for x in (name, quotas[name])])
    branch = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    ranked = df.filter(F.col(kind).isin(names)).withColumn("_rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    # The literal limit reaches the map side: no task sorts more of a kind than any quota.
    return ranked.filter(F.col("_rank") <= max(quotas.values(), default=0)).filter(F.col("_rank") <= quota[F.col(kind)]).withColumn("branch", branch[F.col(kind)]).drop("_rank")


def last_n_chronological(df: DataFrame, key: str, order: Sequence[str], n: int, position: str = "position") -> DataFrame:
    """Last ``n`` rows of each key, numbered from 1 in chronological order."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    oldest = Window.partitionBy(key).orderBy(F.col("_back").desc())
    return kept.withColumn(position, F.row_number().over(oldest)).drop("_back")
