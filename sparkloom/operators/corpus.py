"""Search documents from catalog tables: one branch per kind, all with one schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import top_n_per_group
from sparkloom.operators.relational import lookup_array


def branch(rows: DataFrame, kind: str, source: str, ident: str, text: Column, **metadata: Column) -> DataFrame:
    """Documents of one kind: doc_type, source_table, source_id, content_text and the metadata given."""
    fields = [value.alias(name) for name, value in metadata.items()]
    return rows.select(F.lit(kind).alias("doc_type"), F.lit(source).alias("source_table"), F.col(ident).cast("long").alias("source_id"), text.alias("content_text"), *fields)


def corpus(branches: Sequence[DataFrame]) -> DataFrame:
    """All branches; metadata that a kind lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def with_notice(text: Column, active: Column, notice: str) -> Column:
    """Text, with a notice after it where ``active`` is false."""
    return F.when(active == F.lit(False), F.concat(text, F.lit(notice))).otherwise(text)


def listed(kind: Column, prefix: str, cost: Column, least: int, most: int, markers: Sequence[str] = ()) -> Column:
    """Ids with the prefix and a cost in range that contain none of the markers (any case)."""
    marked = F.lower(kind).rlike("|".join(m.lower() for m in markers)) if markers else F.lit(False)
    return kind.startswith(prefix) & cost.between(least, most) & ~marked


def described(name: Column, description: Column, variant: str = "<rules>") -> Column:
    """Rows with a description whose name is not that of a variant."""
    return description.isNotNull() & (description != "") & ~name.contains(variant)


def top_builds(builds: DataFrame, group: str, order: Sequence[Column], n: int, items: str, names: DataFrame, key: str, value: str, row_key: Sequence[str]) -> DataFrame:
    """The best ``n`` builds of each group with ``items`` as names, in order; an unknown item keeps its id."""
    best = top_n_per_group(builds, [group], list(order), n)
    return lookup_array(best, items, names, key, value, "item_names", list(row_key))
