"""Helpers that several operators share: scratch tables, buckets, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by the cluster.

    Only a plain local session (tests) may fall back on a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, keeps column pruning, and gives the
    optimizer true sizes, so that it broadcasts only what it has seen to be small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though the body uses it often."""
    return F.transform(F.array(value), body)[0]


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no special order.

    A group may hold most of the rows: each is split into hash buckets, the buckets
    are counted (map-side combined), and only bucket counts meet in a window. ``df``
    is read twice, so pass a materialized table. ``order`` must tell rows apart;
    rows that it does not tell apart are alike, and any order of them will do.
    """
    spark = df.sparkSession
    buckets = max(shuffle_partitions(spark), df.count() // per_bucket + 1)
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    numbered = cut.withColumn("_r", F.row_number().over(within) - 1)
    return join_on(numbered, starts, [*group, "_b"], "left").select(*df.columns, (F.col("_r") + F.col("_before")).cast("long").alias(name))


def range_splits(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending cut points that deal ``key`` out about evenly.

    One mergeable sketch over one column; a bounded list of numbers comes back.
    """
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * buckets)).alias("s")).first()
    return sorted(set(row["s"] or []))


def join_on(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come back once."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
