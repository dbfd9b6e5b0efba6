"""Document fingerprints by randomised edit embedding.

All documents share one random walk rule: at step j a walk that stands on character c
stays or moves on by a random bit of (j, c). The characters seen step by step are the
embedding; few edits change few of them, because two walks that were pushed apart soon
meet again. The fingerprint samples the embedding at shared positions, 128 one-bit
samples in every power-of-two range of steps, so texts of any length compare bit by
bit. Likeness is the weighted agreement of the ranges, with chance agreement removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, range_splits, shuffle_partitions
from sparkloom.llm.simhash import _labels, components

#: Shared randomness: bits repeat after PERIOD steps and per class of characters.
SEED, PERIOD, CLASSES = 2024, 1 << 16, 64
#: Steps in the first range (each later range is as long as all before it), bits sampled in each.
FIRST, SAMPLES = 32, 128
#: Cells of a block of walks that run side by side, characters gathered before they run.
BLOCK_CELLS, GATHER_CHARS = 3_000_000, 8_000_000


def _dwell() -> np.ndarray:
    """dwell[c, j]: steps that a walk arriving at step j stays on a character of class c."""
    bits = np.random.default_rng(SEED).random((CLASSES, PERIOD)) < 0.5
    bits[:, ::64] |= ~bits.any(axis=1, keepdims=True)
    after = np.where(np.concatenate([bits, bits], axis=1), np.arange(2 * PERIOD), 4 * PERIOD)
    nearest = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (nearest - np.arange(PERIOD) + 1).astype(np.int32)


_DWELL = _dwell().ravel()


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _ranges(end: int) -> int:
    """Number of sampled ranges of a walk of ``end`` steps."""
    return 0 if end <= 0 else max(0, int(end - 1) // FIRST).bit_length() + 1


def _positions(scale: int) -> np.ndarray:
    low, high = (0, FIRST) if scale == 0 else (FIRST << (scale - 1), FIRST << scale)
    return np.sort(np.random.default_rng([SEED, scale]).integers(low, high, SAMPLES))


_POSITIONS = [_positions(s) for s in range(40)]


def walks(codes: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """Arrival step of each character, and last the step after the end, of many walks.

    Walks of like length run side by side, one character of all of them at a time.
    """
    out: list[np.ndarray | None] = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    at = 0
    while at < len(order):
        longest = len(codes[order[at]])
        group = order[at : at + max(1, BLOCK_CELLS // (longest + 1))]
        at += len(group)
        k = len(group)
        classes = np.zeros((longest, k), np.int32)
        for column, i in enumerate(group):
            classes[: len(codes[i]), column] = (_mix(codes[i]) >> np.uint64(58)).astype(np.int32) * PERIOD
        times = np.empty((longest + 1, k), np.int32)
        times[0] = now = np.array([starts[i] for i in group], np.int32)
        lengths = np.array([len(codes[i]) for i in group])
        active = k - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        for j, m in enumerate(active.tolist()):
            part = now[:m]
            part += _DWELL[classes[j, :m] + (part & (PERIOD - 1))]
            times[j + 1, :m] = part
        for column, i in enumerate(group):
            out[i] = times[: lengths[column] + 1, column].copy()
    return out


def _sample(codes: np.ndarray, times: np.ndarray) -> str:
    """Fingerprint: the walk's length (8 or more hex digits), then its bits by range."""
    end = int(times[-1])
    n = _ranges(end)
    if n == 0:
        return f"{end:08x}-"
    at = np.concatenate(_POSITIONS[:n])
    inside = at < end
    seen = np.searchsorted(times, at[inside], side="right") - 1
    bits = np.zeros(len(at), np.uint8)
    bits[inside] = (_mix(codes[seen]) >> (np.flatnonzero(inside) % 53).astype(np.uint64)).astype(np.uint8) & 1
    return f"{end:08x}-{np.packbits(bits).tobytes().hex()}"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts; equal texts have equal ones."""
    codes = [_codes(t) for t in texts]
    return [_sample(c, t) for c, t in zip(codes, walks(codes, [0] * len(codes)), strict=True)]


def likeness(a: str, b: str) -> float:
    """0 to 1: estimated share of the longer walk on which both see the same characters."""
    if a == b:
        return 1.0
    (end_a, bits_a), (end_b, bits_b) = ((int(e, 16), np.frombuffer(bytes.fromhex(x), np.uint8)) for e, x in (a.split("-"), b.split("-")))
    end = max(end_a, end_b)
    n = _ranges(end)
    both = np.zeros((2, n * SAMPLES // 8), np.uint8)
    both[0, : len(bits_a)], both[1, : len(bits_b)] = bits_a, bits_b
    differs = np.unpackbits(both[0] ^ both[1]).reshape(n, SAMPLES)
    total = 0.0
    for scale in range(n):
        low, high = (0, FIRST) if scale == 0 else (FIRST << (scale - 1), FIRST << scale)
        valid = int(np.searchsorted(_POSITIONS[scale], end)) if end < high else SAMPLES
        if valid:
            total += (min(end, high) - low) * (1 - 2 * int(differs[scale, :valid].sum()) / valid)
    return min(1.0, max(0.0, total / end))


def bands(fingerprint: str, size: int = 16) -> list[str]:
    """Band keys: bits of the longest whole range of the walk, ``size`` at a time.

    The range's number is part of the key. The range before it is taken too, so that
    texts whose walks end on two sides of a range border still share one.
    """
    end, bits = fingerprint.split("-")
    n, digits, step = _ranges(int(end, 16)), SAMPLES // 4, size // 4
    keys = []
    for scale in {max(0, n - 2), max(0, n - 3)}:
        part = bits[scale * digits : (scale + 1) * digits]
        keys += [f"{scale}:{i}:{part[i : i + step]}" for i in range(0, len(part), step)]
    return keys or ["empty"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; null and empty texts share one fingerprint."""

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_texts([t or "" for t in texts]), dtype=object)

    return docs.select("doc_id", work("text").alias("fingerprint"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable over likeness >= threshold).

    Equal fingerprints are one class, so copies never meet as pairs. Classes that share
    a band are verified against each other; only edges to one member per group leave a
    task. Banding is a sampled search: it finds a pair at likeness 0.8 with near
    certainty (16 bands of 16 bits), but it is not exhaustive.
    """
    prints = materialize(fingerprints(docs), "edit-prints")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).withColumn("node", F.xxhash64("fingerprint")), "edit-classes")
    band_keys = F.udf(lambda x: bands(x), "array<string>")
    banded = classes.select("node", "fingerprint", F.explode(band_keys("fingerprint")).alias("band"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            open_band = rows["band"].iloc[-1] if len(rows) else None
            held = rows[rows["band"] == open_band]
            yield edges(rows[rows["band"] != open_band])
        if held is not None:
            yield edges(held)

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, group in rows.groupby("band"):
            nodes, fps = group["node"].to_numpy(), group["fingerprint"].tolist()
            x, y = [], []
            for i in range(len(fps)):
                for j in range(i):
                    if likeness(fps[i], fps[j]) >= threshold:
                        x.append(i)
                        y.append(j)
            label = _labels(len(fps), np.array(x, np.int64), np.array(y, np.int64))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            a += nodes[moved].tolist()
            b += nodes[label[moved]].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    n = shuffle_partitions(docs.sparkSession)
    found = banded.repartition(n, "band").sortWithinPartitions("band").mapInPandas(verify, "a long, b long").distinct()
    roots = components(found)
    linked = classes.join(roots, "node")
    named = linked.join(linked.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    labels = classes.join(named, "node", "left").select("fingerprint", F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(labels, "fingerprint").select("doc_id", "component_id")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are.

    The next document is the one with the next smaller doc_id (after the last: the
    first; equal ids by text, null ids last). The edited text has the last third of the
    code points replaced by as many from the start of the next text. Keys are dealt
    into ranges, sorted there, and the first row of each range is also sent to the
    range that precedes it in descending order; no task sees more than its range.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, shared_bands (of the text and its edited text).
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"))
    cuts = np.array(range_splits(rows, "key", n), np.int64)

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), side="left").astype(np.int32))

    # At most one row per range comes back.
    tops = {r["b"]: r["top"] for r in rows.select(bucket_of("key").alias("b"), "key").groupBy("b").agg(F.max("key").alias("top")).collect()}
    full = sorted(tops)
    before = {tops[b]: full[(i + 1) % len(full)] for i, b in enumerate(full)}

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, keys.to_numpy(np.int64), side="left").tolist()
        return pd.Series([[b, before[k]] if k in before else [b] for b, k in zip(own, keys.tolist(), strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(tuple(x.as_py() for x in row))
                gathered = sum(len(r[3]) for r in held) if len(held) % 256 == 0 or len(held[-1][3]) > GATHER_CHARS // 8 else 0
                if gathered >= GATHER_CHARS:
                    yield compare(held)
                    held = held[-1:]
        # The last row of a range stands for the range that follows, and is not compared.
        yield compare(held)

    def compare(held: list[tuple]) -> pa.RecordBatch:
        """All rows but the last: each with the row after it."""
        index = [i for i in range(len(held) - 1) if held[i][1] == 0]
        texts = [r[3] for r in held]
        codes = [_codes(t) for t in texts]
        times = walks(codes, [0] * len(codes))
        own = [_sample(c, t) for c, t in zip(codes, times, strict=True)]
        cut = {i: len(codes[i]) - len(codes[i]) // 3 for i in index}
        tails = [codes[i + 1][: len(codes[i]) // 3] for i in index]
        tail_times = walks(tails, [int(times[i][cut[i]]) for i in index])
        out = ([], [], [], [], [], [], [], [])
        for i, tail, later in zip(index, tails, tail_times, strict=True):
            k = cut[i]
            edited = _sample(np.concatenate([codes[i][:k], tail]), np.concatenate([times[i][:k], later]))
            text = texts[i][:k] + texts[i + 1][: len(codes[i]) // 3]
            row = (
                held[i][2], len(codes[i]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), own[i], edited,
                likeness(own[i], edited), likeness(own[i], own[i + 1]), len(set(bands(own[i])) & set(bands(edited))),
            )
            for values, value in zip(out, row, strict=True):
                values.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_bands"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"
    dealt = rows.select("doc_id", "key", "text", F.posexplode(targets("key")).alias("mark", "bucket"))
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "mark", F.desc("key"), "text")
    return ordered.select("bucket", "mark", "doc_id", "text").mapInArrow(work, schema)
