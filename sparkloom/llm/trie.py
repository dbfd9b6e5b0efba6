"""Prefix trie of conversations, summed up by leaf-peeling message passing.

* Turns are numbered, and prefixes named, by running sums over sorted ranges: a
  prefix's name is the sum of its turns' digests, each salted with its place. A
  conversation that holds most rows is spread over tasks like any other.
* Nodes are groups of equal names. Each node follows the member whose keyed hash is the
  smallest; nodes that follow the same member form a chain, which ends where that member
  ends. On the way from the root to any leaf the smallest hash changes only about as
  often as the logarithm of the members, however long the conversations are.
* Peeling works on chains: each holds a counter of the chains that hang on it. Those with
  none left send their totals to the chain above, whose counter falls; rounds end when
  the root's chain is done. Sums from the end of each chain then give every node's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import join_on, materialize, shuffle_partitions

#: Hex digits in each part of a digest; sums of 2^23 parts still fit 63 bits.
PART_DIGITS, PARTS = 10, 4
#: Ids in a piece of a node's list of ends.
PIECE_IDS = 10_000


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums within each group, in order, the row itself included.

    Rows are dealt out by ranges of (group, order) and written down with their range; what
    comes before a range in its first group is added to the sums within the range. A
    group may span any number of ranges. Rows alike in ``order`` come in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    keyed = df.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(sums.values())], *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    ranks = [F.col(f"_o{i}") for i in range(len(order))]
    dealt = materialize(keyed.repartitionByRange(n, *group, *ranks).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = [f"_s{i}" for i in range(len(sums))]
    totals = dealt.groupBy(*group, "_p").agg(*[F.sum(c).alias(c) for c in parts], F.count(F.lit(1)).alias("_n"))
    # One group at most reaches into a range from the one before: as many rows as ranges.
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "_p", *[F.sum(c).over(before).alias(f"_c{c}") for c in parts]).filter(F.col(f"_c{parts[0]}").isNotNull())
    within = Window.partitionBy(*group, "_p").orderBy(*ranks).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_r{c}": F.sum(c).over(within) for c in parts})
    out = join_on(summed, F.broadcast(carried), [*group, "_p"], "left")
    return out.select(*df.columns, *[(F.col(f"_r{c}") + F.coalesce(F.col(f"_c{c}"), F.lit(0))).alias(name) for c, name in zip(parts, sums, strict=True)])


def rebuilt(turns: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """conv_id, depth (from 1), role, text: every conversation's rebuilt turns.

    Conversation c starts with the first h turns of c - c % ``family``, and goes on with
    its own turns after its first h; h is the crc32 of c in decimal, modulo ``shared``.
    Turns are ordered by turn (null first), then role and text; a null role or text is
    empty. Rows without a conv_id belong to no conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    order = [F.col("turn"), F.col("role"), F.col("text")]
    placed = materialize(running_sums(rows, ["conv_id"], order, {"place": F.lit(1).cast("long")}).select("conv_id", "place", "role", "text"), "turns")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared))
    convs = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    sizes = materialize(convs.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % family}), "conversations")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("_there"))
    known = sizes.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("_there", F.lit(0))))
    first = placed.filter(F.col("place") <= shared - 1).withColumnRenamed("conv_id", "base")
    lent = first.join(known.select("conv_id", "base", "h"), "base").filter(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "role", "text")
    kept = placed.join(known.select("conv_id", "h", "taken"), "conv_id").filter(F.col("place") > F.col("h"))
    return lent.unionByName(kept.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "role", "text"))


def _digest() -> list[Column]:
    """A turn's digest, salted with its depth, in parts that can be added up."""
    whole = F.sha2(F.concat_ws("\0", F.col("depth").cast("string"), F.octet_length("role").cast("string"), "role", "text"), 256)
    return [F.conv(F.substring(whole, 1 + i * PART_DIGITS, PART_DIGITS), 16, 10).cast("long") for i in range(PARTS)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, bytes, node and parent of every rebuilt turn."""
    cut = materialize(turns.select("conv_id", "depth", F.octet_length("text").cast("long").alias("bytes"), *[c.alias(f"d{i}") for i, c in enumerate(_digest())]), "digests")
    named = running_sums(cut, ["conv_id"], [F.col("depth")], {f"s{i}": F.col(f"d{i}") for i in range(PARTS)})
    name = lambda depth, parts: F.concat_ws(".", depth.cast("string"), *parts)
    own = name(F.col("depth"), [F.hex(f"s{i}") for i in range(PARTS)])
    above = name(F.col("depth") - 1, [F.hex(F.col(f"s{i}") - F.col(f"d{i}")) for i in range(PARTS)])
    return named.select("conv_id", "depth", "bytes", own.alias("node"), above.alias("parent"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """node and the digest of the sorted, comma-joined conv_ids that end there.

    Ids are sorted by ranges and joined to pieces where they lie; a node's pieces then
    pass through one digest in order, held one at a time: a SHA-256 is made in sequence.
    """
    import hashlib
    from itertools import groupby

    def pieces(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for node, part in frame.groupby("node", sort=False)["conv_id"]:
                ids = part.tolist()
                rows += [(node, ids[i], ",".join(map(str, ids[i : i + PIECE_IDS]))) for i in range(0, len(ids), PIECE_IDS)]
            if rows:
                yield pd.DataFrame(rows, columns=["node", "first", "ids"])

    def digests(batches):
        import pandas as pd

        def rows():
            for frame in batches:
                yield from zip(frame["node"], frame["ids"], strict=True)

        done = []
        for node, part in groupby(rows(), key=lambda r: r[0]):
            digest, lead = hashlib.sha256(), ""
            for _, ids in part:
                digest.update((lead + ids).encode())
                lead = ","
            done.append((node, digest.hexdigest()))
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=["node", "ends_sha256"])
                done = []
        if done:
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])

    n = shuffle_partitions(ends.sparkSession)
    cut = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(pieces, "node string, first long, ids string")
    return cut.repartition(n, "node").sortWithinPartitions("node", "first").select("node", "ids").mapInPandas(digests, "node string, ends_sha256 string")


def peel(chains: DataFrame) -> DataFrame:
    """Totals of every chain with all that hangs on it: chain, onto, at, leaves, saved.

    ``chains`` has chain, onto (the chain above, null for the root's), at (the node that
    it hangs on), pending (chains that hang on it), leaves and saved (its own). Each round
    the chains with nothing pending send their totals and leave.
    """
    active = chains
    finished: DataFrame | None = None
    while not active.isEmpty():
        ready = active.filter("pending = 0")
        done = ready.select("chain", "onto", "at", "leaves", "saved")
        finished = done if finished is None else finished.unionByName(done)
        sent = ready.groupBy("onto").agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")).withColumnRenamed("onto", "chain")
        none = F.lit(0).cast("long")
        active = materialize(
            active.filter("pending > 0").join(sent, "chain", "left").select(
                "chain", "onto", "at", (F.col("pending") - F.coalesce("_n", none)).alias("pending"),
                (F.col("leaves") + F.coalesce("_leaves", none)).alias("leaves"), (F.col("saved") + F.coalesce("_saved", none)).alias("saved"),
            ), "peeled",
        )
    return chains.select("chain", "onto", "at", "leaves", "saved") if finished is None else finished


def prefix_trie(conversations: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (see ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, bytes of each node's last text
    times its members but one), ends_sha256. The root's members are all conversations,
    those without turns included. Repeated rows are turns of their own. Rows without a
    conv_id are left out; a table without others has no root and gives no row. Other
    columns are not read.
    """
    ids = conversations.select(F.col("conv_id").cast("long")).filter("conv_id is not null").distinct()
    convs = materialize(ids, "ids")
    steps = materialize(_prefixes(rebuilt(conversations, family, shared)), "prefixes")
    root = ".".join(["0", *["0"] * PARTS])
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"))
    members = steps.unionByName(tops)
    priority = F.struct(F.xxhash64("conv_id"), F.col("conv_id"))
    grouped = members.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.min(priority)["conv_id"].alias("chain"),
    )
    nodes = materialize(grouped, "nodes")
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("onto"))
    none = F.lit(0).cast("long")
    linked = materialize(
        nodes.join(children, "node", "left").join(above, "parent", "left").select(
            "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "chain", "onto", F.coalesce("n_children", none).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"),
        ), "links",
    )
    heads = linked.filter(F.col("onto").isNull() | (F.col("onto") != F.col("chain"))).select("chain", "onto", F.col("parent").alias("at"))
    own = linked.groupBy("chain").agg(F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
    hanging = heads.groupBy("onto").agg(F.count(F.lit(1)).alias("pending")).withColumnRenamed("onto", "chain")
    chains = heads.join(own, "chain").join(hanging, "chain", "left").select("chain", "onto", "at", F.coalesce("pending", none).alias("pending"), "leaves", "saved")
    totals = peel(materialize(chains, "chains"))
    arrived = totals.groupBy("at").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")).withColumnRenamed("at", "node")
    weighed = linked.join(arrived, "node", "left").withColumns({"leaf": F.col("leaf") + F.coalesce("_leaves", none), "save": F.col("save") + F.coalesce("_saved", none)})
    from_end = running_sums(weighed.drop("_leaves", "_saved"), ["chain"], [-F.col("depth")], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("save")})
    # A conversation ends at its deepest prefix.
    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "node"))["node"].alias("node"))
    empty = F.sha2(F.lit(""), 256)
    out = from_end.join(_ends_digest(ends.select("node", "conv_id")), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
