"""Event logs: rows appended from frames and streams; a batch that comes again adds nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

#: The three logs (fixed values).
CHAT_LOG = "session_id string, version string, question string, intent string, doc_ids array<long>, answer string, latency_ms long, cold_start boolean, created_at timestamp"
LINK_CLICKS = "session_id string, chat_log_id long, target_page string, clicked_at timestamp"
ACCOUNT_EVENTS = "account_hash string, region string, event_type string, match_id string, latency_ms long, created_at timestamp"

#: A start counts as cold from this latency on (fixed value).
COLD_START_MS = 10_000


def cold_start(latency_ms: Column, least: int = COLD_START_MS) -> Column:
    return latency_ms >= least


def log_rows(df: DataFrame, schema: str, at: str) -> DataFrame:
    """``df`` as rows of a log: its columns by name and type; those absent are null.

    ``at``, the time of the event, is the present if absent or null, and ``cold_start``
    follows from ``latency_ms`` where the log has both and ``df`` only that.
    """
    wanted = StructType.fromDDL(schema)

    def value(field) -> Column:
        if field.name == "cold_start" and field.name not in df.columns:
            return cold_start(F.col("latency_ms"))
        given = F.col(field.name) if field.name in df.columns else F.lit(None)
        return F.coalesce(given.cast(field.dataType), F.current_timestamp()) if field.name == at else given.cast(field.dataType)

    return df.select(*[value(f).alias(f.name) for f in wanted.fields])


def append_batch(rows: DataFrame, path: str, source: str, batch: int) -> bool:
    """Add a batch to the log at ``path`` unless that batch of ``source`` is there whole already.

    A batch has a folder of its own, which is finished by Spark's success marker; what an
    attempt left without one is written over. Returns whether anything was written.
    """
    if not re.fullmatch(r"\w+", source):
        raise ValueError(f"source: {source!r}")
    spark, folder = rows.sparkSession, f"{path}/source={source}/batch={int(batch)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    rows.write.mode("overwrite").parquet(folder)
    return True


def append_stream(rows: DataFrame, path: str, source: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of log rows; a micro-batch that is run again after a failure adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, source, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log, with the source and batch that they came by."""
    return spark.read.schema(f"{schema}, source string, batch long").option("basePath", path).parquet(path)
