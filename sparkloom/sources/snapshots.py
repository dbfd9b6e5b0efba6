"""Versioned tables as Parquet folders with a manifest, append-only logs, and which version is current.

Whatever is written gets a folder of its own, which never changes. The manifest, a log,
tells which folders make up a version: its last row on the version rules. Spark commits
an appended row whole or not at all, so readers see the version before or after, and
those who have begun keep the folders that they took until ``sweep`` finds them out of
use for long enough. Another log, of promotions, tells which version readers take.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

RUNS = "triggered_at timestamp, version_before string, version_after string, duration_ms long, status string, detail string"
PROMOTIONS = "version string, promoted_at timestamp, id string"
MANIFEST = "number long, version string, folders array<string>, schema string, written_at timestamp, id string"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; only a local session may fall back on a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sparkloom/{label}-{uuid.uuid4().hex}"


def _checked(version: str) -> str:
    if not re.fullmatch(r"\d+\.\d+", version):
        raise ValueError(f"version: {version!r}")
    return version


def manifest(spark: SparkSession, path: str) -> list:
    """All rows of a table's manifest in order; one row for each publication or retirement."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return []
    return sorted(rows.collect(), key=lambda r: (r["number"], r["written_at"], r["id"]))


def record(spark: SparkSession, path: str, version: str, folders: Sequence[str], schema: StructType | None) -> None:
    """Make ``folders``, the first whole and the others changes to it, the version from now on; none retire it."""
    number = max((r["number"] for r in manifest(spark, path)), default=0) + 1
    append(spark, f"{path}/manifest", [(number, _checked(version), list(folders), schema.json() if schema else None, datetime.now(UTC), uuid.uuid4().hex)], MANIFEST)


def live(spark: SparkSession, path: str) -> dict[str, object]:
    """Each version's last manifest row, in the order in which the versions were first published."""
    last = {r["version"]: r for r in manifest(spark, path)}
    return {v: r for v, r in last.items() if r["folders"]}


def new_folder(path: str, version: str) -> str:
    """Name of a folder below ``path`` that nothing else uses."""
    return f"data/{_checked(version)}-{uuid.uuid4().hex}"


def publish(df: DataFrame, path: str, version: str) -> None:
    """Write one version, replacing it as a whole if it is there; an empty ``df`` clears it.

    Readers of the version before are not disturbed. Other versions stay as they are.
    """
    folder = new_folder(path, version)
    df.write.parquet(f"{path}/{folder}")
    record(df.sparkSession, path, version, [folder], df.schema)


def folders_of(spark: SparkSession, path: str, version: str) -> list[DataFrame]:
    """What makes up a version, the whole first and then the changes to it in order; an error if it isn't there."""
    row = live(spark, path).get(_checked(version))
    if row is None:
        raise ValueError(f"{path} has no version {version}")
    whole = StructType.fromJson(json.loads(row["schema"]))
    read = lambda folder, schema: spark.read.schema(schema).parquet(f"{path}/{folder}")
    return [read(folder, whole if not i else changed(whole)) for i, folder in enumerate(row["folders"])]


#: Marks a changed row that is no longer there.
GONE = "_gone"


def changed(whole: StructType) -> StructType:
    """Schema of changes to a table."""
    return StructType(list(whole.fields) + [StructField(GONE, BooleanType())])


def read_version(spark: SparkSession, path: str, version: str, keys: Sequence[str] | None = None) -> DataFrame:
    """The rows of one version, with ``version`` as text; other folders are not listed.

    A version that was refreshed in part is put together by its ``keys`` (null equals
    null): the last change of a key rules, and rows without a change are read as they lie.
    """
    whole, *changes = folders_of(spark, path, version)
    if changes:
        if not keys:
            raise ValueError("keys are needed to read a version with changes")
        whole = with_changes(whole, changes, keys)
    return whole.withColumn("version", F.lit(version))


def with_changes(whole: DataFrame, changes: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``whole`` without the keys that changed, and their last rows unless those are gone."""
    columns = whole.columns
    last = changes[0]
    if len(changes) > 1:
        numbered = reduce(DataFrame.unionByName, [c.withColumn("_at", F.lit(i)) for i, c in enumerate(changes)])
        rest = F.struct(*[c for c in [*columns, GONE] if c not in keys])
        last = numbered.groupBy(*keys).agg(F.max_by(rest, "_at").alias("_r")).select(*keys, "_r.*")
    touched = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return whole.join(touched, same, "left_anti").unionByName(last.filter(~F.col(GONE)).select(*columns))


def retire(spark: SparkSession, path: str, keep: int, pinned: Sequence[str] = ()) -> list[str]:
    """Take all versions off the manifest but the ``keep`` first published last, and those ``pinned``.

    Their folders stay until ``sweep``. Returns the versions retired.
    """
    there = list(live(spark, path))
    out = [v for v in there[: max(0, len(there) - keep)] if v not in pinned]
    for v in out:
        record(spark, path, v, [], None)
    return out


def sweep(spark: SparkSession, path: str, grace: timedelta) -> list[str]:
    """Delete the folders that no version has used for ``grace``; returns their names.

    ``grace`` must be longer than any reader or writer takes. A folder of a publication
    that failed counts from its last change.
    """
    until, rows = datetime.now(UTC) - grace, manifest(spark, path)
    used = {f for r in live(spark, path).values() for f in r["folders"]}
    ended: dict[str, datetime] = {}
    before: dict[str, object] = {}
    for r in rows:
        if r["version"] in before:
            ended |= {f: r["written_at"] for f in before[r["version"]]["folders"]}
        before[r["version"]] = r
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root) if files.exists(root) else []:
        folder = f"data/{status.getPath().getName()}"
        end = ended.get(folder, datetime.fromtimestamp(status.getModificationTime() / 1000, UTC))
        if folder not in used and end.astimezone(UTC) <= until and files.delete(status.getPath(), True):
            gone.append(folder)
    return sorted(gone)


def append(spark: SparkSession, path: str, rows: Sequence[tuple], schema: str) -> None:
    """Append a few event rows to a log as one file."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)


def promote(spark: SparkSession, log: str, version: str, tables: Sequence[str]) -> None:
    """Make ``version`` current; every table must have it."""
    for path in tables:
        if _checked(version) not in live(spark, path):
            raise ValueError(f"{path} has no version {version}")
    append(spark, log, [(version, datetime.now(UTC), uuid.uuid4().hex)], PROMOTIONS)


def current_version(spark: SparkSession, log: str) -> str | None:
    """The version promoted last; None before the first promotion."""
    try:
        promotions = spark.read.schema(PROMOTIONS).parquet(log)
    except AnalysisException:
        return None
    return promotions.agg(F.max_by("version", F.struct("promoted_at", "id")).alias("v")).first()["v"]


def run_steps(spark: SparkSession, runs: str, before: str | None, after: str, steps: Sequence[Callable[[], object]], finish: Callable[[], object]) -> bool:
    """Run steps in order, then ``finish`` if all succeeded; always append a row on the run.

    The first failing step ends the run: what it and earlier steps wrote stays, and
    ``finish`` (a promotion, say) does not happen. Returns whether all succeeded.
    """
    began, status, detail = datetime.now(UTC), "success", None
    try:
        for step in [*steps, finish]:
            step()
    except Exception as e:  # noqa: BLE001  (any failure is recorded)
        status, detail = "failed", str(e)[:500]
    took = int((datetime.now(UTC) - began).total_seconds() * 1000)
    append(spark, runs, [(began, before, after, took, status, detail)], RUNS)
    return status == "success"


def on_change(current: str | None, upstream: str, act: Callable[[str], object]) -> bool:
    """Call ``act`` with the upstream version if it is not the current one."""
    if current == upstream:
        return False
    act(upstream)
    return True
