"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a doubly linked list. The heap holds adjacent pairs by merge
rank, leftmost first; popping a pair joins its symbols and pushes the two new pairs.
The count of a word is its initial symbols minus the merges made; no identifiers are
looked up. A word of n symbols takes O(n log n), so one endless word does no harm.
"""

from __future__ import annotations

import json
import re
from functools import cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps before the cache starts anew.
CACHE_WORDS = 1_000_000

#: Texts of these characters only are cut by the plain pattern, others by the full one.
_PLAIN = re.compile(r"[\x09-\x0D -~À-ÖØ-öø-ÿ]*")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in one word."""
    n = len(symbols)
    symbols, made = [*symbols, None], 0
    following, previous = list(range(1, n + 2)), list(range(-1, n))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        left, j = symbols[i], following[i]
        if left is None or j >= n or ranks.get((left, symbols[j])) != rank:
            continue  # one of the two was merged meanwhile
        made += 1
        symbols[i] = joined = left + symbols[j]
        symbols[j] = None
        k = following[i] = following[j]
        if k < n:
            previous[k] = i
            if (r := ranks.get((joined, symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = previous[i]
        if h >= 0 and (r := ranks.get((symbols[h], joined))) is not None:
            heappush(heap, (r, h))
    return made


class Counter:
    """Counts tokens of texts under a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        file = json.loads(Path(path).read_text())
        self._ranks = {tuple(pair): rank for rank, pair in enumerate(file["model"]["merges"])}
        self._special = [t["content"] for t in file["added_tokens"]]
        self._split = re.compile("|".join(map(re.escape, self._special))).split
        self._words = regex.compile(pattern).findall
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self._names = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        symbols = list(word.encode().decode("latin-1").translate(self._names))
        return len(symbols) - merges(symbols, self._ranks)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none, a special string is one."""
        if not text:
            return 0
        parts = self._split(text)
        total = len(parts) - 1
        for part in parts:
            words = (_PLAIN_WORDS if _PLAIN.fullmatch(part) else self).findall(part)
            known = self._known
            new = list(set(words).difference(known))
            if new and len(known) > CACHE_WORDS:
                known.clear()
                new = list(set(words))
            for w in new:
                known[w] = self._word(w)
            total += sum(map(known.__getitem__, words))
        return total

    def findall(self, text: str) -> list[str]:
        return self._words(text)


@cache
def counter(path: str, pattern: str) -> Counter:
    """One counter per worker process."""
    return Counter(path, pattern)


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Column of token counts; one row in, one row out, so any repeats stay repeats."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        one = counter(path, pattern).count
        return pd.Series([one(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, UTF-8 bytes, tokens, and whether they exceed ``limit``, for every row.

    Null and empty texts have 0 bytes and 0 tokens. Other columns are not read.
    """
    return (
        docs.select(F.col(key), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text), path, pattern).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
