"""Trigram word similarity, as column expressions and for long texts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def trigrams(text: Column) -> Column:
    """Trigrams of the lower-cased words of a text in order, words padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similarity(a: Column, b: Column) -> Column:
    """Best share of ``a``'s trigrams in common with a stretch of ``b``; for short strings.

    The share is common trigrams by all trigrams of both; every stretch of ``b``'s
    trigrams between two common ones is tried, which takes the square of their number. 0
    if either has no trigram, null if either is null.
    """

    def best(x: Column, y: Column) -> Column:
        def of(i: Column, j: Column) -> Column:
            stretch = F.array_distinct(F.slice(y, i, j - i + 1))
            return _let(F.size(F.array_intersect(x, stretch)), lambda k: k / (F.size(x) + F.size(stretch) - k))

        # A best stretch starts and ends on a common trigram.
        hits = F.filter(F.sequence(F.lit(1), F.size(y)), lambda i: F.array_contains(x, F.get(y, i - 1)))
        return _let(hits, lambda at: F.coalesce(F.array_max(F.transform(at, lambda i: F.array_max(F.transform(F.filter(at, lambda j: j >= i), lambda j: of(i, j))))), F.lit(0.0)))

    found = _let(F.array_distinct(trigrams(a)), lambda x: _let(trigrams(b), lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(best(x, y))))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def _grams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return [p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(w) + 1)]


def best_stretch(a: str, b: str) -> float:
    """Word similarity of two texts; only stretches that start and end on a common trigram can win."""
    wanted, seq = set(_grams(a)), _grams(b)
    if not wanted or not seq:
        return 0.0
    hits = [i for i, g in enumerate(seq) if g in wanted]
    best = 0.0
    for n, i in enumerate(hits):
        seen, common = set(), set()
        at = i
        for j in hits[n:]:
            seen.update(seq[at : j + 1])
            at = j + 1
            common.add(seq[j])
            best = max(best, len(common) / (len(wanted) + len(seen) - len(common)))
            if best * len(seen) > len(wanted):
                break  # a longer stretch has too many other trigrams
    return best


def word_similarity_long(query: str):
    """Column function of long texts: their word similarity with a fixed query, in Arrow batches."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else best_stretch(query, t) for t in texts], dtype="float64")

    return score


def char_overlap(name: Column, query: Column) -> Column:
    """Share of a name's distinct characters (blanks aside) that the query has; 0 for an empty name."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: F.trim(x) != ""))
    n = F.size(letters(name))
    return F.when(n > 0, F.size(F.array_intersect(letters(name), letters(query))) / n).otherwise(0.0)


def best_of_list(query: Column, values: Column) -> Column:
    """Best word similarity of any element with the query; 0 for none."""
    return F.coalesce(F.array_max(F.transform(values, lambda v: word_similarity(v, query))), F.lit(0.0))


def relevance(query: str, names: list[str], lists: list[str], content: str, list_weight: float = 0.9, content_weight: float = 0.5) -> Column:
    """Greatest of the name scores, the weighted list scores and the weighted content score."""
    q = F.lit(query)
    scores = [word_similarity(F.col(n), q) for n in names] + [best_of_list(q, F.col(c)) * list_weight for c in lists]
    scores.append(word_similarity_long(query)(F.col(content)) * content_weight)
    return F.coalesce(F.greatest(*scores, F.lit(None).cast("double")), F.lit(0.0))


def with_thresholds(df: DataFrame, kind: str, score: str, thresholds: dict[str, float]) -> DataFrame:
    """Rows whose kind has no threshold, or whose score reaches it."""
    ok = reduce(lambda c, item: c.when(F.col(kind) == item[0], F.col(score) >= item[1]), thresholds.items(), F.when(F.lit(False), F.lit(False)))
    return df.filter(ok.otherwise(F.lit(True))) if thresholds else df
