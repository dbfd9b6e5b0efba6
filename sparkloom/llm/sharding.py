"""Shards of equal bytes by a k-d tree over document metadata.

Rows with equal texts form a group that stays together; a group weighs the bytes of
all its rows. The tree splits its nodes at weighted medians along the metadata
dimension that is widest in the node, until each leaf has one shard's bytes. All nodes
of a level are split at once. A weighted median is found by narrowing 12 bits of the
ordering key at a time over weights summed by node and bin, so what comes back to the
driver per round is bounded by shards times bins, not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, number_rows

#: Bits of a coordinate, and of the ordering key read per round. A key is a
#: coordinate followed by a hash of the text, so ties on the metadata can be split.
BITS, DIGIT = 24, 12
DIMENSIONS = ("length", "lang", "source")


@dataclass
class _Node:
    name: int
    first: int  # its shards are first ... first + count - 1
    count: int


def _coordinate(column: Column) -> Column:
    """A value in [0, 2**BITS) for a categorical column; null has its own."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)).bitwiseAND((1 << BITS) - 1)


def groups(docs: DataFrame, extra_bytes: int = 16) -> tuple[DataFrame, DataFrame]:
    """The rows without their texts, and the groups of equal texts with their weights."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id"), (F.octet_length(text) + extra_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).substr(1, 32).alias("_group"), F.char_length(text).alias("_chars"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        ),
        "shard-rows",
    )
    long = F.least(F.lit((1 << BITS) - 1), (F.log2(F.col("_chars") + 1) * F.lit((1 << BITS) / 32)).cast("long"))
    weighed = rows.groupBy("_group").agg(
        F.sum("size").alias("weight"), F.max("_chars").alias("_chars"), F.min("_lang").alias("_lang"), F.min("_source").alias("_source")
    )
    low = F.conv(F.substring("_group", 1, 6), 16, 10).cast("long")
    return rows, materialize(weighed.select("_group", "weight", long.alias("length"), _coordinate(F.col("_lang")).alias("lang"), _coordinate(F.col("_source")).alias("source"), low.alias("_low")), "shard-groups")


def kd_tree(points: DataFrame, shards: int) -> DataFrame:
    """Give each weighted point its ``shard``, by splits that halve the shards of a node."""
    spark = points.sparkSession
    nodes = [_Node(0, 0, shards)]
    placed = points.withColumn("_node", F.lit(0))
    while any(node.count > 1 for node in nodes):
        widest = _widest(placed)
        parents = [n for n in nodes if n.count > 1 and n.name in widest]
        cuts = _medians(placed, {n.name: (widest[n.name], n.count // 2 / n.count) for n in parents})
        children = []
        for n in nodes:
            half = n.count // 2
            if n.name in cuts:
                children += [_Node(2 * n.name + 1, n.first, half), _Node(2 * n.name + 2, n.first + half, n.count - half)]
            else:  # a single shard, or a node without points
                children.append(_Node(2 * n.name + 1, n.first, 1))
        sides = spark.createDataFrame([(n.name, widest[n.name], cuts[n.name]) for n in parents], "_node int, _dim int, _cut long")
        # One row per node: at most as many as shards.
        joined = placed.join(F.broadcast(sides), "_node", "left")
        right = F.coalesce(_key(F.col("_dim")) > F.col("_cut"), F.lit(False)).cast("int")
        placed = materialize(joined.select(*points.columns, (2 * F.col("_node") + 1 + right).alias("_node")), "shard-tree")
        nodes = children
    names = F.create_map(*[F.lit(x) for n in nodes for x in (n.name, n.first)])
    return placed.select(*points.columns, names[F.col("_node")].alias("shard"))


def _key(dim: Column) -> Column:
    value = F.coalesce(*[F.when(dim == i, F.col(d)) for i, d in enumerate(DIMENSIONS)])
    return value * (1 << BITS) + F.col("_low")


def _widest(placed: DataFrame) -> dict[int, int]:
    spans = placed.groupBy("_node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    return {r["_node"]: max(range(len(DIMENSIONS)), key=lambda i: (r[DIMENSIONS[i]], -i)) for r in spans}


def _medians(placed: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """The key of each node at which the weight up to it is nearest the wanted share."""
    spark = placed.sparkSession
    rest: dict[int, float] = {}
    prefix = {name: 0 for name in wanted}
    for shift in range(2 * BITS - DIGIT, -1, -DIGIT):
        state = spark.createDataFrame([(name, dim, prefix[name]) for name, (dim, _) in wanted.items()], "_node int, _dim int, _prefix long")
        keyed = placed.join(F.broadcast(state), "_node").withColumn("_k", _key(F.col("_dim")))
        bins = keyed.filter(F.shiftright("_k", shift + DIGIT) == F.col("_prefix")).groupBy("_node", F.shiftright("_k", shift).alias("_bin")).agg(F.sum("weight").alias("w"))
        weights: dict[int, list[tuple[int, int]]] = {}
        for r in bins.collect():  # at most nodes x 2**DIGIT rows
            weights.setdefault(r["_node"], []).append((r["_bin"], r["w"]))
        for name, (_, share) in wanted.items():
            found = sorted(weights[name])
            target = rest.setdefault(name, share * sum(w for _, w in found))
            for k, (b, w) in enumerate(found):
                if target <= w or k == len(found) - 1:
                    break
                target -= w
            if shift == 0 and target < w / 2 and k:  # nearer without the last key than with it
                b = found[k - 1][0]
            elif shift == 0 and target < w / 2:
                b -= 1
            prefix[name], rest[name] = b, target
    return prefix


def shard(docs: DataFrame, shards: int = 40, extra_bytes: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Sizes are UTF-8 bytes (a null text has none) plus ``extra_bytes``. Rows with equal
    texts share a shard, whatever their metadata; the group takes its smallest lang and
    source. Null lang, source and doc_id are values like any other. Slots number a
    shard's rows from 0. A group of more bytes than a shard cannot be evened out.
    """
    rows, points = groups(docs, extra_bytes)
    if points.isEmpty():
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = kd_tree(points, shards).select("_group", "shard")
    return number_rows(materialize(rows.join(placed, "_group").drop("_chars", "_lang", "_source"), "sharded"), ["shard"], ["doc_id", "_group"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents as Parquet, one folder per shard, for training readers."""
    placed = kd_tree(groups(docs)[1], shards).select("_group", "shard")
    keyed = docs.withColumn("_group", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).substr(1, 32))
    keyed.join(placed, "_group").drop("_group").write.partitionBy("shard").parquet(path)
