"""Refresh of some kinds of rows of a stored version: only what changed is written.

Rows are told apart by keys and compared by a digest of all other columns. The changes
become a folder beside the version's others, which are neither read whole (only keys and
digest are, where the digest is stored) nor written again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import snapshots

DIGEST = "row_digest"


def with_digest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the SHA-256 of its columns besides the keys, nulls included."""
    rest = sorted(c for c in df.columns if c not in keys and c != DIGEST)
    return df.withColumn(DIGEST, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))


def changes(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], missing: Mapping[str, Column] | str | None = None) -> DataFrame:
    """Rows that differ: all columns, ``_gone``, and ``change`` (inserted, updated, missing).

    Both frames have the same columns, with a digest. Of incoming rows with one key, that
    with the largest digest counts. Stored keys that are not incoming stay as they are
    (``missing`` None), go (``"drop"``), or get new values: columns that may use the stored
    row's, where that changes it.
    """
    columns = stored.columns
    rest = F.struct(*[c for c in columns if c not in keys and c != DIGEST], DIGEST)
    new = incoming.select(*columns).groupBy(*keys).agg(F.max_by(rest, DIGEST).alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    there = stored.select(*keys, F.col(DIGEST).alias("_old"), F.lit(True).alias("_there"))
    pick = lambda frame, change: frame.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_n.*", F.lit(False).alias(snapshots.GONE), change.alias("change")).select(*columns, snapshots.GONE, "change")
    put = new.join(there, same, "left").filter(F.col("_there").isNull() | (F.col("_old") != F.col(f"_n.{DIGEST}")))
    out = pick(put, F.when(F.col("_there").isNull(), "inserted").otherwise("updated"))
    if missing is None:
        return out
    left = stored.join(new.drop("_n"), same, "left_anti")
    if isinstance(missing, str):
        if missing != "drop":
            raise ValueError(f"missing: {missing!r}")
        return out.unionByName(left.withColumns({snapshots.GONE: F.lit(True), "change": F.lit("missing")}))
    again = with_digest(left.withColumnRenamed(DIGEST, "_old").withColumns(dict(missing)), [*keys, "_old"]).filter(F.col(DIGEST) != F.col("_old")).drop("_old")
    return out.unionByName(again.withColumns({snapshots.GONE: F.lit(False), "change": F.lit("missing")}).select(*columns, snapshots.GONE, "change"))


def publish(df: DataFrame, path: str, version: str, keys: Sequence[str]) -> None:
    """Publish a version that can be refreshed."""
    snapshots.publish(with_digest(df, keys), path, version)


def read(spark: SparkSession, path: str, version: str, keys: Sequence[str]) -> DataFrame:
    return snapshots.read_version(spark, path, version, keys).drop("version", DIGEST)


def refresh(spark: SparkSession, path: str, version: str, incoming: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], missing: Mapping[str, Column] | str | None = None) -> dict[str, int]:
    """Bring the rows of some kinds of a stored version to ``incoming``; how many rows changed, by change.

    Incoming and stored rows of other kinds are not looked at. If nothing changed, the
    version's manifest stays as it is. Readers see the version before or after.
    """
    entry = snapshots.live(spark, path).get(version)
    stored = snapshots.read_version(spark, path, version, keys).drop("version").filter(F.col(kind).isin(list(kinds)))
    wanted = with_digest(incoming.filter(F.col(kind).isin(list(kinds))), keys)
    folder = snapshots.new_folder(path, version)
    changes(stored, wanted, keys, missing).write.parquet(f"{path}/{folder}")
    counts = {r["change"]: r["count"] for r in spark.read.parquet(f"{path}/{folder}").groupBy("change").count().collect()}
    if counts:
        snapshots.record(spark, path, version, [*entry["folders"], folder], stored.schema)
    return counts


def compact(spark: SparkSession, path: str, version: str, keys: Sequence[str]) -> None:
    """Write a version's rows and changes as one folder again."""
    snapshots.publish(snapshots.read_version(spark, path, version, keys).drop("version"), path, version)
