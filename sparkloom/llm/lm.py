"""Context-tree weighting over bytes, and a word unigram model to hold it against.

A byte is eight binary decisions, each with its context: the ``depth`` bytes before it
and the bits of the byte so far. Every node (context length, context, bits so far)
keeps how often 0 and 1 followed. Its Krichevsky-Trofimov estimate is mixed with the
mixture of the next longer contexts; the weight is the share of the evidence that
speaks for stopping here, worked out bottom-up over the whole training corpus. A text's
score is the log probability of its bytes and an end mark; from it follows its code
length per byte. Where a longer context was never seen, the mixture ends before it.

Counting runs as map-side combined sums over all training texts. Codes of held-out texts
take part with a count of 0, so every code that a text has lies in the tree. Codes meet
by the ``NEAR`` bytes before them; there the longer contexts' nodes are worked out, and
only those of ``NEAR`` bytes go on to the shorter ones, by one aggregation per length.
Mixtures are then passed from short contexts to longer ones by one join per length and
to the same groups of codes, which leaves one log probability per code. The codes seen
most often travel to every task; all others are joined. No node is left out, whatever the
corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

DEPTH = 5
#: Texts are counted and scored in batches of so many bytes; each takes some 60 times that in arrays.
GATHER_BYTES, SCORE_BYTES = 5_000_000, 1_000_000
#: Words that travel to every task; all others are joined. A word is at most so long.
HOT_WORDS, HOT_WORD_BYTES = 1 << 16, 64
#: Codes that travel to every task, at most; slots to find them by, and codes looked up at a time.
HOT_CODES, SLOT_BITS, PIECE = 1 << 21, 22, 1 << 18
#: Bytes of context by which codes meet, and rows of whole groups that are worked out at a time, about.
NEAR, GROUP_ROWS = 3, 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the key as text leaves the remainder kept out of training; null keys train."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def codes_of(texts: list[bytes], depth: int) -> np.ndarray:
    """Each byte and end mark with the ``depth`` bytes before it, packed; texts start after zeros."""
    pad = b"\0" * depth
    flat = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum([depth + len(t) + 1 for t in texts])
    out = np.zeros(len(flat), np.uint64)
    for k in range(depth + 1):
        before = flat[: len(flat) - k].astype(np.uint64)
        before <<= np.uint64(8 * k)
        out[k:] |= before
    inside = np.ones(len(flat), bool)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for k in range(depth):
        inside[starts + k] = False
    return out[inside]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    texts, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            texts.append(_bytes(t.as_py()))
            size += len(texts[-1])
            if size >= GATHER_BYTES:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _coded(train: DataFrame, depth: int) -> DataFrame:
    """code (context and byte, packed) and n, several times over."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _gathered(batches):
            codes, n = np.unique(codes_of(texts, depth), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return train.select("text").mapInArrow(work, "code long, n long")


def context_counts(train: DataFrame, depth: int = DEPTH, apart: DataFrame | None = None) -> DataFrame:
    """code and n over all texts of ``train``; codes that only ``apart`` has come with 0."""
    coded = _coded(train, depth)
    if apart is not None:
        coded = coded.unionByName(_coded(apart, depth).withColumn("n", F.lit(0).cast("long")))
    return coded.groupBy("code").agg(F.sum("n").alias("n"))


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes) and c over all texts; the empty word stands for the end of a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _gathered(batches):
            counts = Counter()
            for t in texts:
                counts.update(t.split())
            counts[b""] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    return train.select("text").mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, exact to about 1e-12."""
    steps = F.lit(0.0)
    for i in range(8):
        steps = steps + F.ln(x + i)
    y = x + 8.0
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - steps


def _evidence() -> Column:
    """Log probability of a node's bits under the Krichevsky-Trofimov estimate."""
    e = _log_gamma(F.col("n0") + 0.5) + _log_gamma(F.col("n1") + 0.5) - _log_gamma(F.col("n0") + F.col("n1") + 1.0) - math.log(math.pi)
    return F.when(F.col("n0") + F.col("n1") == 0, F.lit(0.0)).otherwise(e)


def _longest(counts: DataFrame) -> DataFrame:
    """Nodes of the longest contexts: context, prefix, n0, n1, mixed."""
    bits = counts.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    deep = bits.select(
        F.expr("shiftright(code, 8)").alias("context"),
        F.expr("shiftleft(1, b) + shiftright(code & 255, 8 - b)").cast("int").alias("prefix"),
        F.expr("shiftright(code, 7 - b) & 1").alias("bit"), "n",
    )
    n0, n1 = (F.sum(F.when(F.col("bit") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))
    return deep.groupBy("context", "prefix").agg(n0, n1).withColumn("mixed", _evidence())


def _levels(level: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes shorter than those of ``level`` (``depth`` bytes) by context length, longest first: context, prefix, n0, n1, mixed, stop."""
    levels = []
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << (8 * d)) - 1)
        summed = level.groupBy(shorter.alias("context"), "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("below"))
        here = summed.withColumn("e", _evidence())
        high = F.greatest("e", "below")
        mixed = here.withColumn("mixed", math.log(0.5) + high + F.ln(F.exp(F.col("e") - high) + F.exp(F.col("below") - high)))
        level = materialize(mixed.withColumn("stop", F.exp(math.log(0.5) + F.col("e") - F.col("mixed"))).select("context", "prefix", "n0", "n1", "mixed", "stop"), "ctw-nodes")
        levels.append(level)
    return levels


def tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All nodes: node (context length, context and bits so far, packed), n, p1, stop.

    ``p1`` is the estimate for a 1, ``stop`` the weight of stopping at this node.
    """
    longest = materialize(_longest(counts), "ctw-nodes")
    packed = [
        level.select(
            (F.lit((depth - i) << 56) + F.shiftleft("context", 8) + F.col("prefix")).cast("long").alias("node"), (F.col("n0") + F.col("n1")).alias("n"),
            ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).alias("p1"), "stop",
        )
        for i, level in enumerate([longest.withColumn("stop", F.lit(1.0)), *_levels(longest, depth)])
    ]
    nodes = packed[0]
    for p in packed[1:]:
        nodes = nodes.unionByName(p)
    return nodes


_SMALL = 4096
#: Log gamma of n + 1/2, less that of 1/2, and of n + 1.
_HALVES, _WHOLES = (np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + x))]) for x in (0.5, 1.0))


def _log_gammas(n: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    out, large = small[np.minimum(n, _SMALL)], np.flatnonzero(n > _SMALL)
    x = n[large] + shift
    out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    if shift < 1:
        out[large] -= 0.5 * math.log(math.pi)
    return out


def _evidences(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """:func:`_evidence` of arrays of counts."""
    return _log_gammas(n0, _HALVES, 0.5) + _log_gammas(n1, _HALVES, 0.5) - _log_gammas(n0 + n1, _WHOLES, 1.0)


@dataclass
class _Level:
    """Nodes of one context length; ``at`` tells each longer node's (or code's) place among them."""

    n0: np.ndarray
    n1: np.ndarray
    mixed: np.ndarray
    stop: np.ndarray
    at: np.ndarray


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _upwards(code: np.ndarray, n: np.ndarray, b: int, depth: int, near: int) -> tuple[np.ndarray, list[_Level]]:
    """Decision ``b`` of whole groups of codes: keys of the nodes of ``near`` bytes, and the levels down from the longest to them."""
    context = code >> 8
    key = ((context & ((1 << (8 * near)) - 1)) << 8) + (1 << b) + ((code & 255) >> (8 - b))
    for d in range(near, depth):
        key = (key << 8) + ((context >> (8 * d)) & 255)
    order = np.argsort(key)
    key, n, bit = key[order], n[order], (code[order] >> (7 - b)) & 1
    starts, place = _starts(key)
    at = np.empty(len(code), np.int64)
    at[order] = place
    n0, n1 = np.add.reduceat(n * (1 - bit), starts), np.add.reduceat(n * bit, starts)
    levels = [_Level(n0, n1, _evidences(n0, n1), np.ones(len(n0)), at)]
    key = key[starts]
    for _ in range(near, depth):
        key = key >> 8
        starts, at = _starts(key)
        n0, n1, below = (np.add.reduceat(x, starts) for x in (levels[-1].n0, levels[-1].n1, levels[-1].mixed))
        e = _evidences(n0, n1)
        mixed = math.log(0.5) + np.logaddexp(e, below)
        levels.append(_Level(n0, n1, mixed, np.exp(math.log(0.5) + e - mixed), at))
        key = key[starts]
    return key, levels


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come in the order of the first column, cut only where that one changes."""
    held, size, enough = [], 0, GROUP_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= enough:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield [c[:cut] for c in rows]
            # The last group may go on in the next batch.
            held, size = [[c[cut:].copy() for c in rows]], size - cut
            enough = max(GROUP_ROWS, 2 * size)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def code_logs(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, n and log10 (log10 probability of the code's byte after its context) for every code.

    ``counts`` is read twice. From the root down, ``above`` is what shorter contexts add
    to the estimate for a 1 and ``rest`` the weight they leave; ``q`` is the mixture that
    ends at the node. A node without counts has the mixture of the longest context that
    was counted.
    """
    near = min(NEAR, depth)
    group = F.expr("shiftright(code, 8)").bitwiseAND((1 << (8 * near)) - 1).alias("near")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, n in _whole_groups(batches):
            for b in range(8):
                key, levels = _upwards(code, n, b, depth, near)
                top = levels[-1]
                columns = (key >> 8, (key & 255).astype(np.int32), top.n0, top.n1, top.mixed)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "prefix", "n0", "n1", "mixed"])

    coded = counts.select(group, "code", "n").repartition("near").sortWithinPartitions("near")
    level = materialize(coded.mapInArrow(up, "context long, prefix int, n0 long, n1 long, mixed double"), "ctw-nodes")
    n0, n1 = F.col("n0"), F.col("n1")
    p1 = (n1 + 0.5) / (n0 + n1 + 1.0)
    down = None
    for d, shorter in enumerate(reversed(_levels(level, near))):
        if down is None:
            here = shorter.withColumn("above", F.lit(0.0)).withColumn("rest", F.lit(1.0)).withColumn("q", F.lit(0.5))
        else:
            here = shorter.withColumn("_shorter", F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1)).join(down, ["_shorter", "prefix"])
        here = here.withColumn("q", F.when(n0 + n1 > 0, F.col("above") + F.col("rest") * p1).otherwise(F.col("q")))
        down = here.select(
            F.col("context").alias("_shorter"), "prefix", "q", (F.col("above") + F.col("rest") * F.col("stop") * p1).alias("above"),
            (F.col("rest") * (1 - F.least("stop", F.lit(1.0)))).alias("rest"),
        )

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, code, n, *passed in _whole_groups(batches):
            given = code < 0
            # A node's key is its context and prefix; rows of shorter contexts have the prefix as a negative code.
            keys = (group[given] << 8) - code[given]
            order = np.argsort(keys)
            keys, passed = keys[order], [x[given][order] for x in passed]
            code, n, log10 = code[~given], n[~given], np.zeros(int((~given).sum()))
            for b in range(8):
                key, levels = _upwards(code, n, b, depth, near)
                q, above, rest = (x[np.searchsorted(keys, key)] for x in passed)
                for i, here in reversed(list(enumerate(levels))):
                    p = (here.n1 + 0.5) / (here.n0 + here.n1 + 1.0)
                    q = np.where(here.n0 + here.n1 > 0, above + rest * p, q)[here.at]
                    if i:
                        above, rest = (above + rest * here.stop * p)[here.at], (rest * (1 - np.minimum(here.stop, 1.0)))[here.at]
                log10 += np.log10(np.where(code >> (7 - b) & 1, q, 1 - q))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.array(log10)], names=["code", "n", "log10"])

    nothing = F.lit(0.0)
    shorter = level.select("context", "prefix", F.col("context").bitwiseAND((1 << (8 * (near - 1))) - 1).alias("_shorter"))
    given = shorter.join(down, ["_shorter", "prefix"]).select(F.col("context").alias("near"), (-F.col("prefix")).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), "q", "above", "rest")
    rows = counts.select(group, "code", "n", nothing.alias("q"), nothing.alias("above"), nothing.alias("rest")).unionByName(given)
    return rows.repartition("near").sortWithinPartitions("near").mapInArrow(on, "code long, n long, log10 double")


def _hash(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * _ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Hot:
    """log10 probabilities by code: one code in each slot, those without a slot in order beside."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray) -> None:
        self.cells = np.full((1 << SLOT_BITS, 2), -1, np.int64)
        slot = _hash(codes)
        self.cells[slot, 0] = codes
        # Of codes with one slot, numpy leaves any one; only that one's logarithm may follow.
        placed = self.cells[slot, 0] == codes
        self.cells.view(np.float64)[slot[placed], 1] = logs[placed]
        order = np.argsort(codes[~placed])
        self.codes, self.logs = codes[~placed][order], logs[~placed][order]

    def look(self, codes: np.ndarray) -> np.ndarray:
        """Logarithms of codes; NaN for those that are not here."""
        out = np.empty(len(codes))
        for at in range(0, len(codes), PIECE):
            part = codes[at : at + PIECE]
            cells = self.cells.take(_hash(part), axis=0)
            found = cells.view(np.float64)[:, 1]
            missed = np.flatnonzero(cells[:, 0] != part)
            if len(missed):
                found[missed] = np.nan
                if len(self.codes):
                    place = np.minimum(np.searchsorted(self.codes, part[missed]), len(self.codes) - 1)
                    here = self.codes[place] == part[missed]
                    found[missed[here]] = self.logs[place[here]]
            out[at : at + PIECE] = found
        return out


def hot_codes(logs: DataFrame) -> Hot:
    """The codes seen most often, at most ``HOT_CODES``: all above a count that leaves no more."""
    grade = F.floor(F.log2(F.col("n") + 1) * 16)
    sizes = logs.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect()  # a thousand at most
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > HOT_CODES:
            break
        least = r["grade"]
    rows = logs.filter(grade >= least if least is not None else F.lit(False)).select("code", "log10").toArrow()
    return Hot(rows.column("code").to_numpy(), rows.column("log10").to_numpy())


@dataclass
class Table:
    """Nodes of a small tree in order, to look at it in one process."""

    depth: int
    nodes: np.ndarray
    p1: np.ndarray
    stop: np.ndarray

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte after its context."""
        codes = codes.astype(np.int64)
        context, byte = codes >> 8, codes & 255
        total = np.ones(len(codes))
        for b in range(8):
            prefix, bit = (1 << b) + (byte >> (8 - b)), byte >> (7 - b) & 1
            p, seen = np.full(len(codes), 0.5), np.zeros(len(codes), bool)
            for d in range(self.depth, -1, -1):
                node = (d << 56) + ((context & ((1 << (8 * d)) - 1)) << 8) + prefix
                at = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
                here = self.nodes[at] == node
                p += here * np.where(seen, self.stop[at], 1.0) * (self.p1[at] - p)
                seen |= here
            total *= np.where(bit == 1, p, 1 - p)
        return np.log10(total)


def table(nodes: DataFrame, depth: int = DEPTH) -> Table:
    """All nodes of a small tree, brought to the driver."""
    rows = nodes.select("node", "p1", "stop").orderBy("node").toArrow()
    return Table(depth, *[rows.column(c).to_numpy() for c in ("node", "p1", "stop")])


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Score every row by models of the rows not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte. Texts are lower-cased in A-Z; null and empty texts are an end mark
    alone. Repeated rows train and score as often as they come. If nothing trains, the
    unigram gives every token 1 and the tree every bit one half.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    vocabulary = materialize(word_counts(train), "lm-words")
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = sums["n"] or 0, sums["v"]
    hot_rows = vocabulary.filter(F.length("word") <= HOT_WORD_BYTES).orderBy(F.desc("c"), "word").limit(HOT_WORDS).collect()
    logs_of_codes = materialize(code_logs(materialize(context_counts(train, depth, rows.filter("held_out")), "lm-contexts"), depth), "lm-codes")
    model = spark.sparkContext.broadcast(hot_codes(logs_of_codes))
    hot = spark.sparkContext.broadcast({bytes(r["word"]): math.log10(r["c"] + 1) for r in hot_rows})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known_codes, logs = model.value, hot.value
        row = TaskContext.get().partitionId() << 40

        def flush(held: list[tuple]) -> pa.RecordBatch:
            nonlocal row
            texts = [t for _, _, t in held]
            out = ([], [], [], [], [], [], [], [], [])
            codes = codes_of(texts, depth).astype(np.int64)
            found = known_codes.look(codes)
            missed = np.flatnonzero(np.isnan(found))
            found[missed] = 0
            ends = np.cumsum([len(t) + 1 for t in texts])
            sums = np.add.reduceat(found, np.concatenate([[0], ends[:-1]]).astype(np.int64))
            # Codes left to the join, text by text.
            rare_codes = pa.ListArray.from_arrays(pa.array(np.searchsorted(missed, np.concatenate([[0], ends])).astype(np.int32)), pa.array(codes[missed]))
            for (key, apart, text), s in zip(held, sums.tolist(), strict=True):
                words = Counter(text.split())
                words[b""] = 1
                known = [(n, logs[w]) for w, n in words.items() if w in logs]
                rare = [(w, n) for w, n in words.items() if w not in logs]
                values = (
                    row, key, apart, sum(words.values()), sum(n for n, _ in known), math.fsum(n * x for n, x in known), s,
                    len(text) + 1, [{"word": w, "n": n} for w, n in rare],
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                row += 1
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
            return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out, types, strict=True)), rare_codes], names=names)

        held, size = [], 0
        for batch in batches:
            for key, text, apart in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.append((key.as_py(), apart.as_py(), _bytes(text.as_py())))
                size += len(held[-1][2])
                if size >= SCORE_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "part", "score", "n_codes", "rare", "rare_codes"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, n_codes long, rare array<struct<word:binary,n:long>>, rare_codes array<long>"
    scored = materialize(rows.mapInArrow(work, schema), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    # Words never seen in training add nothing, so an inner join is enough.
    joined = rare.join(vocabulary, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + kinds + 1)
    coded = scored.select("row", F.explode("rare_codes").alias("code")).groupBy("row", "code").count()
    more_score = coded.join(logs_of_codes, "code").groupBy("row").agg(F.sum(F.col("count") * F.col("log10")).alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.drop("rare", "rare_codes").join(joined, "row", "left").join(more_score, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("n_codes")).alias("bits_per_byte"),
    )
