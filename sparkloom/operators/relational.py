"""Lookups, keyed joins and keyed writes on whole DataFrames.

No side is broadcast by hint: Spark broadcasts a lookup table when it has seen it to be
small and shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranges import running, written


def lookup_array(df: DataFrame, array: str, dim: DataFrame, key: str, value: str, out: str, row_key: Sequence[str], on_missing: str = "key") -> DataFrame:
    """Replace each element of ``array`` by ``dim``'s value, in order, as ``out``.

    ``row_key`` identifies a row. ``on_missing``: an unknown element stays as its own
    key (``"key"``), becomes null (``"null"``) or goes (``"drop"``). Rows with empty or
    null arrays stay, with an empty result.
    """
    if on_missing not in ("key", "null", "drop"):
        raise ValueError(f"on_missing: {on_missing}")
    elements = df.select(*row_key, F.posexplode(array).alias("_pos", "_id"))
    known = dim.select(F.col(key).alias("_id"), F.col(value).alias("_value"))
    joined = elements.join(known, "_id", "inner" if on_missing == "drop" else "left")
    text = F.coalesce(F.col("_value"), F.col("_id").cast("string")) if on_missing == "key" else F.col("_value")
    found = joined.groupBy(*row_key).agg(F.sort_array(F.collect_list(F.struct("_pos", text.alias("_value")))).alias("_found"))
    values = F.coalesce(F.transform("_found", lambda x: x["_value"]), F.array().cast("array<string>"))
    return df.join(found, list(row_key), "left").withColumn(out, values).drop("_found")


def last_by_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order`` (null before all others); map-side combined, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    # A struct is never null, so a key whose rows all have a null order keeps one of them.
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_last")).select(*keys, "_last.*")


def localized_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Inner join in which, of right rows with one key, the last wins."""
    return left.join(last_by_key(right, keys, order), list(keys))


def keep_present(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, list(on), "left_semi")


def deactivate_missing(df: DataFrame, incoming: DataFrame, on: Sequence[str], flag: str = "is_active") -> DataFrame:
    """``df`` with ``flag`` false on rows whose key is not incoming; other rows keep theirs."""
    present = incoming.select(*on).distinct().withColumn("_here", F.lit(True))
    return df.join(present, list(on), "left").withColumn(flag, F.col(flag) & F.coalesce("_here", F.lit(False))).select(*df.columns)


def missing_from(df: DataFrame, incoming: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not incoming."""
    return df.join(incoming, list(on), "left_anti")


def merge(base: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), override: Mapping[str, object] | None = None) -> DataFrame:
    """Keyed upsert: incoming rows replace base rows, except for the columns in ``keep``.

    ``override`` sets columns of rows that were matched (a reactivation, say). Two
    incoming rows with one key would make the result undefined and raise an error.
    """
    rest = [c for c in base.columns if c not in keys]
    doubled = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("an incoming key occurs twice")))
    new = incoming.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_new"), doubled.cast("string").alias("_doubled"))
    joined = base.withColumn("_old", F.struct(*rest)).select(*keys, "_old").join(new, list(keys), "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        old, value = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        chosen = F.when(F.col("_new").isNull() | (both & F.lit(c in keep)), old).otherwise(value)
        if override and c in override:
            chosen = F.when(both, F.lit(override[c])).otherwise(chosen)
        return chosen.alias(c)

    return joined.filter(F.col("_doubled").isNull()).select(*[F.col(c) if c in keys else pick(c) for c in base.columns])


def insert_absent(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and those incoming rows whose key it lacks."""
    return base.unionByName(missing_from(incoming, base.select(*keys), keys).select(*base.columns))


def replace_partition(base: DataFrame, incoming: DataFrame, partition: Mapping[str, object]) -> DataFrame:
    """``base`` with one partition's rows replaced by ``incoming``'s rows of it."""
    here = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in partition.items()])
    return base.filter(~here).unionByName(incoming.filter(here).select(*base.columns))


def retain_latest(df: DataFrame, version: str, k: int, pinned: Sequence[object] = (), ordinal: str | None = None) -> DataFrame:
    """Rows of the ``k`` latest versions and of the pinned ones.

    The latest are those with the largest ``ordinal`` (text such as 1.9 and 1.10 does not
    sort by age); without one, the version itself is the order.
    """
    versions = df.groupBy(version).agg(F.max(ordinal or version).alias("_age"))
    latest = versions.orderBy(F.desc("_age"), F.desc(version)).limit(k).select(version)
    kept = latest.union(versions.select(version).filter(F.col(version).isin(*pinned))).distinct() if pinned else latest
    return df.join(kept, version, "left_semi")


def upsert_with_ids(base: DataFrame, incoming: DataFrame, version: str, key: str, ident: str) -> DataFrame:
    """Keyed upsert on (version, natural key) that keeps known surrogate ids and gives out new ones.

    Incoming columns win; new rows get ids above the largest, by version and key. Ids are
    given out over ranges of (version, key), so one version may hold all rows.
    ``version``, ``key`` and ``ident`` of the result are the id map.
    """
    on = [version, key]
    known = base.select(*on, ident)
    merged = written(incoming.join(known, on, "left").select(*base.columns), "merged")
    fresh, old = merged.filter(F.col(ident).isNull()), merged.filter(F.col(ident).isNotNull())
    top = base.agg(F.coalesce(F.max(ident), F.lit(0))).first()[0]
    numbered = running(fresh.drop(ident), [], [F.col(version), F.col(key)], {ident: F.lit(1).cast("long")})
    given = numbered.withColumn(ident, (F.col(ident) + top).cast(base.schema[ident].dataType)).select(*base.columns)
    return missing_from(base, incoming.select(*on), on).unionByName(old).unionByName(given)


def resolve_ids(df: DataFrame, id_map: DataFrame, on: Sequence[str], ident: str) -> DataFrame:
    """``df`` with the surrogate id of its natural key; rows without one go."""
    return df.join(id_map.select(*on, ident), list(on))


def unexpired(df: DataFrame, created: str, now: Column, ttl: Column) -> DataFrame:
    """Rows created less than ``ttl`` (an interval) before ``now``."""
    return df.filter(F.col(created) + ttl > now)


def invalidate(cache: DataFrame, version: str, current: Column) -> DataFrame:
    """The cached rows of the current version; all others go."""
    return cache.filter(F.col(version) == current)


def with_elements(df: DataFrame, array: str) -> DataFrame:
    """Rows whose array has an element; null and empty ones go."""
    return df.filter(F.size(F.coalesce(array, F.array().cast(dict(df.dtypes)[array]))) > 0)


def distinct_elements(df: DataFrame, array: str, out: str) -> DataFrame:
    """Every different element of an array column."""
    return df.select(F.explode(array).alias(out)).distinct()


def union_of_names(*names: tuple[DataFrame, str], out: str = "name") -> DataFrame:
    """Every different name, not null, of any of the columns."""
    return reduce(DataFrame.union, [df.select(F.col(c).alias(out)) for df, c in names]).filter(F.col(out).isNotNull()).distinct()


def collect_children(parents: DataFrame, children: DataFrame, on: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Each parent with the ordered list of its children's ``value`` (empty if none).

    For children of bounded number; ranking.top_n_per_group caps groups beforehand.
    """
    lists = children.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value")))).alias("_l"))
    kind = f"array<{dict(children.dtypes)[value]}>"
    return parents.join(lists, list(on), "left").withColumn(out, F.coalesce(F.transform("_l", lambda x: x["_value"]), F.array().cast(kind))).drop("_l")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must be total; a key's rows are combined before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def placed(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with each row's place from 1; collated columns (``F.collate``) sort by their locale."""
    return running(df, [], list(order), {out: F.lit(1)}).withColumn(out, F.col(out).cast("int"))
