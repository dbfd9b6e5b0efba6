"""Ranked retrieval: score, thresholds, priorities, caps and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.similarity import char_overlap, with_thresholds
from sparkloom.operators.ranges import written
from sparkloom.operators.ranking import capped_top_k, quota_union, split_quota

#: Places of the tier labels; any other label comes last (fixed values).
TIER_PLACES = {"OP": 0, "S": 1, "A": 2, "B": 3, "C": 4}


def tier_priority(tier: Column) -> Column:
    places = F.create_map(*[F.lit(x) for item in TIER_PLACES.items() for x in item])
    return F.coalesce(F.element_at(places, tier), F.lit(5))


def checked_tier(tier: str | None) -> str | None:
    """A tier label as it may be asked for, None for any; another value raises."""
    if tier is not None and tier not in TIER_PLACES:
        raise ValueError(f"tier must be one of {', '.join(TIER_PLACES)}: {tier!r}")
    return tier


def active_priority(active: Column) -> Column:
    """1 for false; true and null are 0."""
    return F.when(active == F.lit(False), 1).otherwise(0)


def search_order(score: str = "relevance", ident: str = "id", tier: str | None = "tier_rank", active: str | None = "is_active", name_score: str | None = None, hit: float = 0.6) -> list[Column]:
    """Active first, name hits first, better tiers first, then relevance, then id."""
    order = [active_priority(F.col(active))] if active else []
    if name_score:
        order.append(F.when(F.col(name_score) >= hit, 0).otherwise(1))
    if tier:
        order.append(tier_priority(F.col(tier)))
    return [*order, F.col(score).desc(), F.col(ident)]


def scored(docs: DataFrame, columns: Sequence[str], scores: Mapping[str, Column]) -> DataFrame:
    """``docs`` with the ``scores`` of their ``columns``, written down, as several searches read them.

    Rows that are alike in ``columns`` (nulls too) are scored once.
    """
    known = written(docs.select(*columns).distinct().withColumns(dict(scores)), "scores").withColumnsRenamed({c: f"_{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return written(docs.join(known, same).select(*docs.columns, *scores), "scored")


def search(scored: DataFrame, order: Sequence[Column], k: int, kind: str | None = None, kinds: Sequence[str] = (), score: str = "relevance", thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Best ``k`` rows of the kinds asked for that reach their kind's threshold."""
    rows = scored.filter(F.col(kind).isin(list(kinds))) if kind and kinds else scored
    if thresholds and kind:
        rows = with_thresholds(rows, kind, score, dict(thresholds))
    return rows.orderBy(*order).limit(max(0, k))


def balanced_search(scored: DataFrame, order: Sequence[Column], kind: str, k: int, kinds: Sequence[str], fixed: Mapping[str, int] | None = None) -> DataFrame:
    """``k`` rows shared among the kinds, remainder to the first; kinds in ``fixed`` have their own number."""
    fixed = dict(fixed or {})
    quotas = split_quota(k, [x for x in kinds if x not in fixed]) | fixed
    return quota_union(scored, kind, order, {x: quotas[x] for x in kinds})


def capped_search(scored: DataFrame, order: Sequence[Column], group: str, cap: int, k: int, first: DataFrame | None = None) -> DataFrame:
    """Best ``k`` rows, at most ``cap`` of a group, after the rows of ``first`` (column ``branch`` tells)."""
    rest = capped_top_k(scored, group, order, cap, k).withColumn("branch", F.lit(1))
    return rest if first is None else first.withColumn("branch", F.lit(0)).unionByName(rest)


def named_only(rows: DataFrame, kind: str, name: str, query: Column, kinds: Sequence[str], share: float = 0.5) -> DataFrame:
    """Drops rows of the given kinds whose name shares too few characters with the query."""
    enough = char_overlap(F.coalesce(F.col(name), F.lit("")), query) >= share
    return rows.filter(~F.col(kind).isin(list(kinds)) | enough)
