"""SimHash near-duplicates, found exactly with vantage-point trees.

Fingerprints of 64 bits link when they differ in at most ``radius`` bits.

* Equal fingerprints become one node, so copies never meet as pairs.
* The bits are cut into ``radius + a`` blocks. Two linked fingerprints agree on at
  least ``a`` of them, so for each choice of ``a`` blocks a vantage-point tree over their
  bits alone deals fingerprints into shards by their distances to shared vantage points.
  Equal bits have equal distances: with a radius of 0, no shard border cuts a link. The
  more fingerprints there are, the larger is ``a``, which keeps shards from growing.
* Inside a shard a vantage-point tree over all 64 bits finds the links: points are
  split at the median distance to a vantage point, and only points within ``radius``
  of the border, by the triangle inequality, are held against the other side. A
  crowded ball is absorbed as one component instead of listing its pairs.
* Each shard yields at most one edge per member; edges are contracted to components by
  joins that are written down each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, shuffle_partitions

SEED = 42
BITS = 64
#: Vantage points per block, and shard sizes up to which all pairs are compared.
LEVELS, BRUTE = 22, 48
#: Spread fingerprints in a shard, about, from which on more blocks have to agree.
SHARD = 4096


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; none without words.

    A-Z are lower-cased. A text of fewer than ``width`` words is one shingle.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def sketch(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes as a signed integer: a bit is set if more than half of them have it; 0 for none."""
    n, set_in = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text's word shingles (repeats count); 0 for a text without words."""
    return sketch(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (a signed long) of every row, texts read whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks of contiguous blocks that cover the 64 bits, sizes at most one apart."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]


def agreeing(points: int, radius: int) -> int:
    """How many blocks must agree, so that a shard of spread fingerprints has about ``SHARD`` of them."""
    return next(a for a in range(1, BITS) if points <= SHARD * 2.0 ** (BITS * a / (radius + a)))


def shards(nodes: DataFrame, radius: int, agree: int = 1) -> DataFrame:
    """fp and shard: each fingerprint once per choice of ``agree`` blocks.

    A block's code is the sides that it takes at its vantage points; a choice's shard is
    told by the codes of its blocks.
    """
    rng = np.random.default_rng(SEED)
    codes = []
    for mask in block_masks(radius + agree):
        middle = mask.bit_count() // 2
        code = F.lit(0).cast("long")
        for level in range(LEVELS):
            vantage = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2)) & mask
            part = F.col("fp").bitwiseAND(_long(mask)).bitwiseXOR(_long(vantage))
            code = code + F.when(F.bit_count(part) > middle, F.lit(1 << level).cast("long")).otherwise(F.lit(0).cast("long"))
        codes.append(code)
    coded = nodes.select("fp", F.array(*codes).alias("codes"))
    cells = [F.xxhash64(F.lit(i), *[F.col("codes")[k] for k in chosen]) for i, chosen in enumerate(combinations(range(len(codes)), agree))]
    return coded.select("fp", F.explode(F.array(*cells)).alias("shard"))


def _long(x: int):
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in each index's component under the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Tree:
    """Links among the distinct fingerprints of one shard, by vantage points."""

    def __init__(self, fps: np.ndarray, radius: int) -> None:
        self.f, self.r = fps, radius
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self._inside(np.arange(len(self.f)))
        if not self.edges:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in self.edges]), np.concatenate([b for _, b in self.edges])

    def _distance(self, one: int, ids: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.f[ids] ^ self.f[one])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a against all of b, in strips; keeps a spanning set of the links."""
        strip = max(1, (1 << 18) // max(1, len(b)))
        for at in range(0, len(a), strip):
            rows = a[at : at + strip]
            i, j = np.nonzero(np.bitwise_count(self.f[rows][:, None] ^ self.f[b][None, :]) <= self.r)
            if len(i):
                members, (x, y) = np.unique(np.concatenate([rows[i], b[j]]), return_inverse=True)[0], (rows[i], b[j])
                label = _labels(len(members), np.searchsorted(members, x), np.searchsorted(members, y))
                moved = np.flatnonzero(label != np.arange(len(members)))
                self.edges.append((members[moved], members[label[moved]]))

    def _inside(self, ids: np.ndarray) -> None:
        while len(ids) > BRUTE:
            d = self._distance(ids[0], ids)
            close = d <= self.r
            if close.sum() * 8 > len(ids):
                ids = self._absorb(ids, close)
                continue
            middle = int(np.median(d))
            near = d <= middle
            if near.all():
                middle -= 1
                near = d <= middle
            self._across(ids[near & (d > middle - self.r)], ids[~near & (d <= middle + self.r)])
            self._inside(ids[near])
            ids = ids[~near]
        if len(ids) > 1:
            self._pairs(ids, ids)

    def _absorb(self, ids: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Grow the first point's component; returns the points that it does not reach."""
        first, waiting, rest = ids[0], list(ids[close][1:]), ids[~close]
        members = list(waiting)
        while waiting and len(rest):
            hit = self._distance(waiting.pop(), rest) <= self.r
            if hit.any():
                waiting += list(rest[hit])
                members += list(rest[hit])
                rest = rest[~hit]
        if members:
            self.edges.append((np.array(members), np.full(len(members), first)))
        return rest

    def _across(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= 1 << 14:
            return self._pairs(a, b)
        da, db = self._distance(a[0], a), self._distance(a[0], b)
        middle = int(np.median(np.concatenate([da, db])))
        na, nb = da <= middle, db <= middle
        if na.all() and nb.all() or not (na.any() or nb.any()):
            return self._pairs(a, b)
        self._across(a[na], b[nb])
        self._across(a[~na], b[~nb])
        self._across(a[na & (da > middle - self.r)], b[~nb & (db <= middle + self.r)])
        self._across(a[~na & (da <= middle + self.r)], b[nb & (db > middle - self.r)])


def _shard_edges(shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to a representative in each shard; rows of a shard stand together."""
    n = len(fps)
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for step in range(1, min(BRUTE, int(sizes.max()))):
        i = np.flatnonzero((shard[:-step] == shard[step:]) & (size[:-step] <= BRUTE))
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        a.append(i)
        b.append(i + step)
    for start, length in zip(starts[sizes > BRUTE].tolist(), sizes[sizes > BRUTE].tolist(), strict=True):
        x, y = _Tree(fps[start : start + length], radius).links()
        a.append(x + start)
        b.append(y + start)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = _labels(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(nodes: DataFrame, radius: int = 4, agree: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` linked within ``radius``.

    ``agree`` blocks decide a fingerprint's shard; by default as many as the number of
    fingerprints asks for.

    Not every linked pair is listed, but every linked pair is connected by edges, and
    every edge joins members of one component.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(shard: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            i, j = _shard_edges(shard, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            shard = np.concatenate([held_shard, shard])
            fps = np.concatenate([held_fp, fp.view(np.uint64)])
            cut = int(np.flatnonzero(shard != shard[-1])[-1]) + 1 if (shard != shard[-1]).any() else 0
            if cut:
                yield found(shard[:cut], fps[:cut])
            held_shard, held_fp = shard[cut:], fps[cut:]
        if len(held_fp):
            yield found(held_shard, held_fp)

    n = shuffle_partitions(nodes.sparkSession)
    dealt = shards(nodes, radius, agree or agreeing(nodes.count(), radius)).select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (one member) for every node of the undirected edges a-b.

    Each round sends every node to its smallest neighbour, follows those steps twice,
    and contracts the edges; chains and stars shrink geometrically.
    """
    edges = materialize(edges.filter("a != b"), "edges")
    mapping: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "steps")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            step = step.join(onward, "to").select("node", F.col("_next").alias("to"))
        step = materialize(step, "steps")
        if mapping is None:
            mapping = step.withColumnRenamed("to", "root")
        else:
            later = step.select(F.col("node").alias("root"), "to")
            mapping = materialize(mapping.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        edges = materialize(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a != b").distinct(), "edges")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    ``component_id`` is the smallest doc_id reachable over links, itself included.
    Null, empty and blank texts have fingerprint 0 and link like any other. A row
    without a doc_id still links its neighbours; its component is null only if no
    member has an id. Repeated rows come back as often as they came.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    labels = materialize(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "labels")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
