"""Landed JSON replies as rows: unwrapping, header tables, keyed entries, localised names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with a given schema, so nothing is scanned to infer one."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def unwrap_reply(body: Column, schema: str) -> Column:
    """The payload of a tool reply: its first text content, parsed; an error reply raises."""
    message = F.get_json_object(body, "$.error.message")
    text = F.get_json_object(body, "$.result.content[0].text")
    return F.from_json(F.when(message.isNotNull(), F.raise_error(F.concat(F.lit("reply: "), message))).otherwise(text), schema)


def table_rows(headers: Column, rows: Column) -> Column:
    """A header list and lists of values as maps; a row of another length raises."""
    fits = F.forall(rows, lambda r: F.size(r) == F.size(headers))
    return F.when(~fits, F.raise_error(F.lit("a row and its headers differ in length"))).otherwise(F.transform(rows, lambda r: F.map_from_arrays(headers, r)))


def pick_entry(entries: Column, field: str, value: object) -> Column:
    """The first struct whose ``field`` has the value; null if none has."""
    return F.get(F.filter(entries, lambda x: x[field] == F.lit(value)), 0)


def localized(names: Column, language: str, ident: Column) -> Column:
    """The name in a language, else the first there is, else the id."""
    wanted = F.when(names[language] != "", names[language])
    return F.coalesce(wanted, F.get(F.map_values(names), 0), ident)


def timestamp_or(raw: Column, otherwise: Column) -> Column:
    """An ISO timestamp, or ``otherwise`` where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(raw), otherwise)


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """``df``, or an error if it has fewer rows than a whole collection must have."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"{found} rows where at least {least} are expected")
    return df


def exploded(df: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """One row per element, its fields beside the columns kept and its place as ``pos``."""
    return df.select(*keep, F.posexplode(array).alias("pos", "_e")).select(*keep, "pos", "_e.*")
