"""Phrase collocations from generalised suffix automata per shard.

A shard is a run of whole texts. Its automaton, bounded to a few words of depth, is built
over all pieces of the shard at once: the tree of an automaton's suffix links is the
trie of its reversed contexts, in which a context that always continues in the same way
shares the state of its continuation. So the states come from grouping positions by
their last word, then by the word before, and so on, with sizes of groups as endpos
counts. Every state spells its substrings, from the length after its suffix link's up to
its own; these counts are added up over all shards.

Shards hand their phrases over in packs, one for each block of the phrases' hash range,
ordered so that phrases with one beginning stand together. All packs of a block meet in
one task, which adds up the counts of equal phrases and keeps the frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.byte_words import cut, runs, separators
from sparkloom.llm.common import materialize, shuffle_partitions

#: Fixed by the contract: what ends a piece, and what parts its words.
PIECE_ENDS = (0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D)
SPACES = (0x20, 0x09)
#: Text bytes in a shard (one longer text is one shard).
SHARD_BYTES = 6 << 20
#: Blocks for each shuffle partition. All packs of a block reach Python at once, as one batch.
BLOCKS = 2
#: Stands for all words of a lang among the packed phrases, which hold none of it.
ALL = "\r"

_WORD = separators(*((b, b) for b in PIECE_ENDS + SPACES))
_ENDS = ~separators(*((b, b) for b in PIECE_ENDS))
_LINE = separators((0x0A, 0x0A))

COUNTS = "lang string, phrase string, words int, f long"


class Automaton:
    """Bounded generalised suffix automaton of a shard.

    ``tokens`` are word ids; ``follows`` tells whether a word follows the one before in
    the same piece. State 0 is the initial one. ``length`` is a state's longest substring
    in words, ``link`` its suffix link, ``endpos`` how often its substrings end, and
    ``end`` a position where they do.
    """

    def __init__(self, tokens: np.ndarray, follows: np.ndarray, depth: int) -> None:
        n = len(tokens)
        here = np.arange(n)
        group = np.zeros(n, np.int64)
        state = np.zeros(1, np.int64)
        self.length, self.link, self.endpos, self.end = [np.array([x], np.int64) for x in (0, -1, n, -1)]
        for k in range(1, depth + 1):
            if k > 1:
                kept = (here >= k - 1) & follows[np.maximum(here - k + 2, 0)]
                here, group = here[kept], group[kept]
            if not len(here):
                break
            word = tokens[here - k + 1]
            key = group * (int(tokens.max()) + 1) + word
            values, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            parent = state[group[first]]
            same = (self.endpos[parent] == counts) & (k > 1)
            state = np.empty(len(values), np.int64)
            state[same] = parent[same]
            self.length[parent[same]] = k
            new = np.flatnonzero(~same)
            state[new] = len(self.length) + np.arange(len(new))
            self.length = np.concatenate([self.length, np.full(len(new), k)])
            self.link = np.concatenate([self.link, parent[new]])
            self.endpos = np.concatenate([self.endpos, counts[new]])
            self.end = np.concatenate([self.end, here[first[new]]])
            group = inverse.astype(np.int64)

    def substrings(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Last position and count of every distinct substring of so many words."""
        spelt = np.flatnonzero((self.length >= words) & (np.where(self.link >= 0, self.length[self.link], -1) < words))
        return self.end[spelt], self.endpos[spelt]


class _Shard:
    """Words of a shard with ids that are distinct for distinct (lang, word)."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        found = cut(texts, _WORD)
        coded, tongue = found.words.dictionary_encode(), langs.fill_null("und").dictionary_encode()
        self.words, self.langs = coded.dictionary, tongue.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        document = found.documents()
        self.lang = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)[document]
        piece = np.searchsorted(np.flatnonzero(_ENDS[found.data]), found.starts)
        self.follows = np.zeros(len(self.word), bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (document[1:] == document[:-1])
        self.token = np.unique(self.lang * max(1, len(self.words)) + self.word, return_inverse=True)[1].astype(np.int64)

        self._hash = _hashes(self.words)[self.word]
        self._lang_hash = _hashes(self.langs)[self.lang]

    def blocks(self, first: np.ndarray, pairs: bool, blocks: int) -> np.ndarray:
        """Block of phrases by their first word, or their first two, which start at ``first``."""
        mixed = (self._lang_hash[first] ^ self._hash[first]) * np.uint64(0x9E3779B97F4A7C15)
        if pairs:
            mixed = (mixed ^ (mixed >> np.uint64(31)) ^ self._hash[first + 1]) * np.uint64(0x165667B19E3779F9)
        return ((((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)

    def phrases(self, ends: np.ndarray, words: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.word[ends - words + 1 + i])) for i in range(words)], " ")

    def packs(self, depth: int, blocks: int) -> pa.RecordBatch:
        """Rows of PACK, one for each block and lang: all substrings of up to ``depth`` words, and the langs' words."""
        automaton = Automaton(self.token, self.follows, depth)
        langs, counts = np.unique(self.lang, return_counts=True)
        groups, phrases, all_counts = [langs], [pa.array([ALL] * len(langs), pa.utf8())], [counts]
        for words in range(1, depth + 1):
            ends, counts = automaton.substrings(words)
            order = np.lexsort([self.token[ends - i] for i in range(words)])
            ends = ends[order]
            groups.append(self.blocks(ends - words + 1, words > 1, blocks) * len(self.langs) + self.lang[ends])
            phrases.append(self.phrases(ends, words))
            all_counts.append(counts[order])
        group = np.concatenate(groups)
        order = np.argsort(group, kind="stable")
        group, counted = group[order], np.concatenate(all_counts)[order].astype("<u4")
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.concat_arrays(phrases).take(pa.array(order)))
        packed = pa.array([counted[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
        block, lang = np.divmod(group[edges[:-1]], len(self.langs))
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), self.langs.take(pa.array(lang)), pc.binary_join(lists, "\n"), packed], names=["block", "lang", "phrases", "counts"])


def _hashes(values: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(v) for v in values.to_pylist()], np.uint64)


PACK = "block int, lang string, phrases string, counts binary"


def phrase_counts(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """COUNTS of phrases of up to ``depth`` words seen ``least`` times or more; with 0 words all words of the lang."""
    parts = BLOCKS * shuffle_partitions(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in runs(batch.column(1), SHARD_BYTES):
                shard = _Shard(*(batch.column(i).slice(begin, end - begin) for i in range(2)))
                if len(shard.word):
                    yield shard.packs(depth, parts)

    def add(held: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
        whole = pa.table([pa.chunked_array([h[i] for h in held]) for i in range(2)], names=["phrase", "f"]).group_by("phrase").aggregate([("f", "sum")]).combine_chunks()
        return whole.column("phrase").combine_chunks(), whole.column("f_sum").combine_chunks()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = None, [], 0

        def frequent() -> pa.RecordBatch:
            phrase, f = add(held)
            kept = pc.or_(pc.greater_equal(f, least), pc.equal(phrase, ALL))
            phrase, f = phrase.filter(kept), f.filter(kept)
            words = pc.if_else(pc.equal(phrase, ALL), pa.scalar(0, pa.int32()), pc.add(pc.count_substring(phrase, " "), pa.scalar(1, pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array([here[1]] * len(f), pa.utf8()), phrase, words, f], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            # One pack at a time: a batch holds many, and Python copies of them all would double it.
            for i in range(batch.num_rows):
                block, lang = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if (block, lang) != here and held:
                    yield frequent()
                    held, size = [], 0
                here = (block, lang)
                counts = np.frombuffer(batch.column(3)[i].as_buffer(), "<u4").astype(np.int64)
                held.append((cut(batch.column(2).slice(i, 1), _LINE).words, pa.array(counts)))
                size += len(held[-1][0])
                if size > 2 * len(held[0][0]) + (1 << 20):
                    held = [add(held)]
                    size = len(held[0][0])
        if held:
            yield frequent()

    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = texts.mapInArrow(pack, PACK).repartitionById(parts, F.col("block")).sortWithinPartitions("block", "lang")
    return dealt.mapInArrow(reduce, COUNTS)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1.

    A group may hold most rows: hash buckets keep their own first ``k``, and buckets are
    merged 32 at a time, so no task ranks more than 32 * k rows of a group after the first.
    ``order`` must tell the rows apart.
    """
    buckets = shuffle_partitions(df.sparkSession)
    out = df.withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    while True:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order))).filter(F.col("rank") <= k)
        if buckets == 1:
            return out.withColumn("rank", F.col("rank").cast("long")).drop("_b")
        buckets = -(-buckets // 32)
        out = out.drop("rank").withColumn("_b", F.pmod("_b", F.lit(buckets)))


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in decimals of up to 38 digits: exact for counts below 10^16."""
    d = lambda c, digits: c.cast(f"decimal({digits},0)")
    product = (d(a, 16) * d(a, 16)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    by = d(l, 16) * d(r, 16)
    return ((product - product % by) / by).cast("long")


def mine(docs: DataFrame, least: int = 10, subsumed_percent: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of two and three words by lang: lang, rank, phrase, a, l, r, n, score.

    Pieces end at ``PIECE_ENDS``, words at spaces and tabs; A-Z are lower-cased. A phrase
    is a candidate if its count ``a`` is ``least`` or more. ``l`` and ``r`` are the counts
    of its parts at the cut with the smallest score (ties: the earlier cut), ``n`` all the
    lang's words. A candidate goes if a longer candidate that holds it has
    ``subsumed_percent`` or more of its count: a triple tells the pair at its suffix link,
    and the pair that it starts with. Null langs are ``und``; null and empty texts have no
    words; repeated rows count again. Fewer than ``top`` candidates come back whole, and
    an empty table gives no row. Other columns are not read.
    """
    found = materialize(phrase_counts(docs, 3, least), "phrases")
    pairs, three = (found.filter(F.col("words") == n) for n in (2, 3))
    part = F.split("phrase", " ")
    piece = lambda first, size: F.array_join(F.slice(part, first, size), " ")
    longer = three.select("lang", F.explode(F.array(piece(2, 2), piece(1, 2))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    free = pairs.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("_longer") >= subsumed_percent * F.col("f"), F.lit(False)))
    counts = found.filter(F.col("words").between(1, 2)).select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    cuts = free.select("lang", "phrase", "words", "f").unionByName(three).select(
        "lang", "phrase", F.col("f").alias("a"),
        F.explode(F.when(F.col("words") == 2, F.array(_cut(1, piece(1, 1), piece(2, 1)))).otherwise(F.array(_cut(1, piece(1, 1), piece(2, 2)), _cut(2, piece(1, 2), piece(3, 1))))).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    for side in ("left", "right"):
        cuts = cuts.join(counts.select("lang", F.col("_part").alias(side), F.col("_f").alias(side[0])), ["lang", side])
    scored = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    first = top_per_group(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    words = found.filter(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(k: int, left: Column, right: Column) -> Column:
    return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
