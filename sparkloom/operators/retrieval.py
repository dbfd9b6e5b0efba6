"""Retrieval for a table of questions: trigram candidates by inverted lists, then exact scores, caps and quotas."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.similarity import best_stretch, trigrams, word_similarity
from sparkloom.operators.ranges import written


@dataclass(frozen=True)
class Field:
    """A column that is scored: a ``name``, a ``list`` of names, or a long ``content``; scores times ``weight``."""

    column: str
    form: str
    weight: float = 1.0


def trigram_pairs(short: DataFrame, long: DataFrame, least: float) -> DataFrame:
    """Pairs (short, long) of distinct texts that can have a word similarity of ``least`` or more.

    Both frames have a column ``text``. A stretch can only score c / n if it has c of the
    short text's n trigrams, so a pair needs that many in common, and then it shares one
    of any n - ceil(least * n) + 1 of them. The rarest are taken: they alone are looked up
    in the long texts' inverted lists, and the whole count is compared for what is found.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    grams = lambda df, name: written(df.select(F.col("text").alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn(f"{name}_grams", F.array_distinct(trigrams(F.col(name)))).filter(F.size(f"{name}_grams") > 0), "trigrams")
    a, b = grams(short, "short"), grams(long, "long")
    lists = b.select(F.explode("long_grams").alias("gram"), "long")
    rarity = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    listed = a.select("short", F.explode("short_grams").alias("gram")).join(rarity, "gram", "left")
    # A gram that no long text has is the rarest of all: it counts, and finds nothing.
    ranked = listed.groupBy("short").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    needed = F.ceil(F.lit(least) * F.size("g") - 1e-9).cast("int")
    prefix = ranked.select("short", F.explode(F.slice("g", F.lit(1), F.size("g") - needed + 1)).alias("g")).select("short", F.col("g.gram").alias("gram"))
    found = prefix.join(lists, "gram").select("short", "long").distinct()
    both = found.join(a, "short").join(b, "long")
    return both.filter(F.size(F.array_intersect("short_grams", "long_grams")) >= F.ceil(F.lit(least) * F.size("short_grams") - 1e-9)).select("short", "long")


def _long_score(short: Column, long: Column) -> Column:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_stretch(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score(short, long)


def relevance_pairs(questions: DataFrame, docs: DataFrame, qid: str, question: str, ident: str, fields: Sequence[Field], least: float, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, ident, relevance: the greatest weighted field score of every pair that reaches ``least``.

    A name or a list's element is looked for in the question, the question in a content.
    Each distinct pair of texts is scored once, whatever number of rows have the texts.
    ``first`` may leave out rows (those of ``docs`` with each ``_value`` of a field)
    before they are paired with questions.
    """
    asked = questions.select(qid, F.col(question).alias("_question"))
    scored = []
    for f in fields:
        if f.weight < least:
            continue  # cannot reach it
        values = docs.withColumn("_value", F.explode(F.array_distinct(f.column)) if f.form == "list" else F.col(f.column))
        values = (written(first(values).select(ident, "_value"), "values") if first else values.select(ident, "_value")).distinct()
        short, long = (asked.withColumnRenamed("_question", "text"), values.withColumnRenamed("_value", "text")) if f.form == "content" else (values.withColumnRenamed("_value", "text"), asked.withColumnRenamed("_question", "text"))
        pairs = trigram_pairs(short, long, least / f.weight)
        score = _long_score(F.col("short"), F.col("long")) if f.form == "content" else word_similarity(F.col("short"), F.col("long"))
        exact = written(pairs.withColumn("_score", score * f.weight).filter(F.col("_score") >= least), "scores")
        names = ("short", "long") if f.form == "content" else ("long", "short")
        named = exact.select(F.col(names[0]).alias("_question"), F.col(names[1]).alias("_value"), "_score")
        scored.append(named.join(asked, "_question").join(values, "_value").select(qid, ident, "_score"))
    if not scored:
        raise ValueError("no field can reach the least score")
    return reduce(DataFrame.unionByName, scored).groupBy(qid, ident).agg(F.max("_score").alias("relevance"))


def retrieve(
    questions: DataFrame, docs: DataFrame, qid: str, question: str, ident: str, kind: str, fields: Sequence[Field], quotas: Mapping[str, int], least: float,
    thresholds: Mapping[str, float] | None = None, group: str | None = None, cap: int | None = None, order: Sequence[Column] = (),
) -> DataFrame:
    """For every question the best documents of each kind up to its quota: ``docs``' columns, relevance, rank.

    A document needs its kind's threshold, or ``least`` where that is higher or there is
    none. ``order`` comes before relevance and id. At most ``cap`` of a question's
    documents of one kind come from one ``group``. Kinds without a quota are left out.
    Equal questions are answered once. Of the documents of one kind and group that have
    one value, only the first ``cap`` by ``order`` and id are paired with questions: each
    of these scores what the value does or more, so any other comes after them. Without
    groups, the greatest quota takes the place of ``cap``. Quotas of up to 1000 are kept
    to on the map side, so that no task holds all of a question's documents.
    """
    docs, most = docs.filter(F.col(kind).isin(list(quotas))), max(quotas.values(), default=0)
    capped = group is not None and cap is not None
    alike = Window.partitionBy("_value", kind, *[group] * capped).orderBy(*order, F.col(ident))

    def first(values: DataFrame) -> DataFrame:
        return values.withColumn("_place", F.row_number().over(alike)).filter(F.col("_place") <= (cap if capped else most))

    asked = questions.select(qid, F.col(question).alias("_asked")).distinct()
    texts = asked.filter(F.col("_asked").isNotNull()).select("_asked", F.col("_asked").alias("_text")).distinct()
    scored = relevance_pairs(texts, docs, "_asked", "_text", ident, fields, least, first)
    rows = scored.join(docs, ident)
    for k, t in (thresholds or {}).items():
        rows = rows.filter((F.col(kind) != k) | (F.col("relevance") >= t))
    best = [*order, F.col("relevance").desc(), F.col(ident)]
    if capped:
        place = F.row_number().over(Window.partitionBy("_asked", kind, group).orderBy(*best))
        rows = rows.withColumn("_cap", place).filter(F.col("_cap") <= cap).drop("_cap")
    quota = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_asked", kind).orderBy(*best)))
    answers = ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= quota[F.col(kind)])
    return answers.join(asked, "_asked").select(ident, qid, "relevance", *[c for c in docs.columns if c != ident], "rank")
