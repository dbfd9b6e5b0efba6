"""Names in answers as Markdown links, by a map of names that each answer has of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

#: Names in single quotes, and names that lead a list item (fixed values).
QUOTED = r"'([^']+)'"
LEADING = r"(?dmU)^-\s+([^:\n]+?):"


def page_url(source: Column, kind: Column, ident: Column, by_source: Mapping[str, str], by_kind: Mapping[str, str], otherwise: str = "/") -> Column:
    """URL of a document: a pattern by its source table, else one by its kind, else ``otherwise``.

    ``{}`` in a pattern stands for the document's id.
    """
    fill = lambda pattern: F.replace(F.lit(pattern), F.lit("{}"), ident.cast("string"))
    out = F.when(F.lit(False), F.lit(otherwise))
    for column, patterns in ((source, by_source), (kind, by_kind)):
        for value, pattern in patterns.items():
            out = out.when(column == value, fill(pattern))
    return out.otherwise(F.lit(otherwise))


def link_targets(docs: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[tuple[Column, Column]], out: str = "targets") -> DataFrame:
    """``keys`` and a map of name to URL: the first document in ``order`` that has a name decides.

    ``names`` are (name, URL) columns, tried in turn within a document; a null or empty
    name and a null URL are passed over. Only the first of each name is gathered, so a
    key's group holds as many entries as it has distinct names.
    """
    slots = F.array(*[F.struct(n.alias("name"), u.alias("url"), F.lit(i).alias("slot")) for i, (n, u) in enumerate(names)])
    named = docs.select(*keys, *order, F.explode(slots).alias("_l")).filter((F.col("_l.name") != "") & F.col("_l.url").isNotNull())
    first = named.groupBy(*keys, F.col("_l.name").alias("_name")).agg(F.min_by("_l.url", F.struct(*order, "_l.slot")).alias("_url"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_url"))).alias(out))


def _rewritten(text: Column, pattern: str, entry) -> Column:
    """The text with every match m of the pattern replaced by ``entry(m, its group)``."""
    between = F.split(text, pattern, -1)
    whole, group = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (0, 1))
    parts = F.transform(whole, lambda m, i: F.concat(entry(m, F.get(group, i)), F.get(between, i + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(parts, ""))


def insert_links(text: Column, targets: Column) -> Column:
    """Quoted names, then names that lead a list item, as links where ``targets`` (a map) has them.

    Other names stay as they are; so does the whole text if ``targets`` is null.
    """
    link = lambda name: F.concat(F.lit("["), name, F.lit("]("), targets[name], F.lit(")"))
    quoted = _rewritten(text, QUOTED, lambda m, name: F.coalesce(link(name), m))
    leading = lambda m, name: F.coalesce(F.when(~name.startswith("["), F.concat(F.lit("- "), link(strip(name)), F.lit(":"))), m)
    return F.when(targets.isNull(), text).otherwise(_rewritten(quoted, LEADING, leading))


def with_links(answers: DataFrame, docs: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[tuple[Column, Column]], text: str, out: str) -> DataFrame:
    """``answers`` with the column ``out``: the text linked by the documents of its keys."""
    return answers.join(link_targets(docs, keys, order, names, "_targets"), list(keys), "left").withColumn(out, insert_links(F.col(text), F.col("_targets"))).drop("_targets")
