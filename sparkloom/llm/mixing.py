"""Mixing sources to target weights by budgets handed down a tree.

Leaves are domain-language-source triples. A budget enters at the root; each node
deals its budget to its children by weight, but no child gets more than the tokens
that its subtree can give (its tokens times ``max_epochs``). What a child cannot take
goes to its siblings first; only what a whole subtree cannot take reaches its
ancestors' other children. A leaf spends its budget on whole epochs and the prefix of
one more, documents taken in an order seeded by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import join_on, materialize, number_rows, words

#: Rows of a leaf in one range of its order, about.
RANGE_ROWS = 4096

LEVELS = ("domain", "lang", "source")

#: Domains of the sources that the registered mix knows; any other source is in ``other``.
DOMAINS = tuple(
    (f"src{i}", domain) for domain, numbers in (("web", range(8)), ("news", range(8, 13)), ("books", range(13, 17)), ("reference", range(17, 19))) for i in numbers
)
#: Target weights at all three levels; ``*`` stands for any node. Reference works and Spanish
#: are asked for more than they have, so their shortage goes to others.
WEIGHTS = (
    ("web", 0.35), ("news", 0.20), ("books", 0.15), ("reference", 0.25), ("other", 0.05),
    ("*/en", 0.40), ("*/de", 0.125), ("*/fr", 0.125), ("*/es", 0.35),
    ("reference/*/src17", 3.0), ("reference/*/src18", 1.0),
)


@dataclass(frozen=True)
class Mix:
    """Budget and target weights.

    ``budget_share`` is the budget as a share of all tokens. ``domains`` tells the domain
    of a source. ``weights`` names nodes by their path (``"web"``, ``"web/en"``,
    ``"*/en"``, ``"web/en/src3"``), the first that fits counts; a node not named gets its
    tokens to the power ``temper``, so name all children of a node or none.
    """

    budget_share: float = 1.0
    max_epochs: int = 2
    temper: float = 0.7
    seed: int = 17
    weights: tuple[tuple[str, float], ...] = WEIGHTS
    domains: tuple[tuple[str, str], ...] = DOMAINS

    def domain_of(self, source: Column) -> Column:
        """Domain of a source; of one that is null or not listed ``other``."""
        if not self.domains:
            return F.lit("other")
        return F.coalesce(F.create_map(*[F.lit(x) for pair in self.domains for x in pair])[source], F.lit("other"))

    def named(self, depth: int) -> Column:
        """Weight of a node at this depth by its name, null if it has none."""
        weight = F.lit(None).cast("double")
        for path, w in reversed(self.weights):
            names = path.split("/")
            if len(names) == depth:
                fits = [F.coalesce(F.col(c), F.lit("")) == name for c, name in zip(LEVELS, names, strict=False) if name != "*"]
                weight = F.when(reduce(and_, fits, F.lit(True)), F.lit(float(w))).otherwise(weight)
        return weight


def _pour(children: DataFrame, parent: list[str]) -> DataFrame:
    """Deal each parent's ``_budget`` to its children by ``_w``, none above ``_cap``.

    Children are ordered by capacity per weight. Going up that order, a child is full if
    its share of what is left would overflow it; the first that is not full, and all
    after it, share the rest by weight.
    """
    order = [F.col("_cap") / F.col("_w"), F.col("_path")]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    marked = children.withColumn("_level", left / F.greatest(weight, F.col("_w"))).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    rest = F.min(F.when(~F.col("_full"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("_level").alias("level")))).over(whole)
    shared = F.greatest(F.lit(0.0), rest["level"]) * F.col("_w")
    return marked.withColumn("_budget", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), shared))).drop("_level", "_full")


def budgets(leaves: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Token budget of each leaf.

    ``leaves`` has domain, lang, source and ``tokens`` (one row per leaf, tokens > 0).
    Returns it with ``budget`` (a whole number of tokens).
    """
    text = [F.coalesce(F.col(c), F.lit("")) for c in LEVELS]

    def node(depth: int) -> DataFrame:
        path = F.concat_ws("/", *text[:depth])
        plain = F.pow(F.sum("tokens").cast("double"), F.lit(mix.temper))
        nodes = leaves.withColumn("_path", path).groupBy(*[F.col(c) for c in LEVELS[:depth]], "_path").agg(plain.alias("_w"), (F.sum("tokens") * mix.max_epochs).cast("double").alias("_cap"))
        return nodes.withColumn("_w", F.coalesce(mix.named(depth), F.col("_w")))

    total = leaves.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 0.0
    poured = _pour(node(1).withColumn("_budget", F.lit(total * mix.budget_share)).withColumn("_root", F.lit(0)), ["_root"]).select("domain", "_budget")
    for depth in (2, 3):
        keys = list(LEVELS[: depth - 1])
        poured = _pour(join_on(node(depth), poured, keys), keys).select(*LEVELS[:depth], "_budget")
    return join_on(leaves, poured, LEVELS).select(*leaves.columns, F.floor(F.col("_budget") + 1e-6).cast("long").alias("budget"))


def _planned(docs: DataFrame, mix: Mix, key: str, text: str) -> DataFrame:
    """_key, _text (hash), the leaf, tokens, epochs and _more (taken once more) of every row."""
    rows = materialize(
        docs.select(
            F.col(key).alias("_key"), mix.domain_of(F.col("source")).alias("domain"), F.col("lang"), F.col("source"),
            F.size(words(F.col(text))).cast("long").alias("tokens"), F.xxhash64(F.col(text)).alias("_text"),
        ),
        "mix-rows",
    )
    weighed = rows.filter("tokens > 0")
    leaves = materialize(weighed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    # So many bits of the order that a range of a leaf has about RANGE_ROWS rows, in large and small leaves alike.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / RANGE_ROWS))).cast("int")
    dealt = budgets(leaves, mix).select(*LEVELS, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"), bits.alias("_bits"))
    shares = materialize(dealt, "mix-budgets")
    # Leaves are as many as the metadata has values; Spark broadcasts them if it has seen them to be small.
    order = F.xxhash64(F.lit(mix.seed), F.col("epochs"), F.col("_key"), F.col("_text"))
    hashed = join_on(weighed, shares, LEVELS).withColumn("_h", order).withColumn("_range", F.expr("if(_bits = 0, 0L, shiftright(_h, 64 - _bits))"))
    sums = hashed.groupBy(*LEVELS, "_range", "rest").agg(F.sum("tokens").alias("_t"))
    upto = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    marks = sums.withColumn("_before", F.coalesce(F.sum("_t").over(upto), F.lit(0)))
    # One range per leaf holds the cut.
    holds = (F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("_t"))
    known = join_on(hashed, materialize(marks.filter(holds).select(*LEVELS, F.col("_range").alias("_cut"), "_before"), "mix-cuts"), LEVELS)
    within = Window.partitionBy(*LEVELS, "_range").orderBy("_h", "_key", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = known.filter(F.col("_range") == F.col("_cut")).withColumn("_more", F.col("_before") + F.sum("tokens").over(within) <= F.col("rest"))
    clear = known.filter(F.col("_range") != F.col("_cut")).withColumn("_more", F.col("_range") < F.col("_cut"))
    columns = ["_key", "_text", *LEVELS, "tokens", "epochs", "_more"]
    none = rows.filter("tokens = 0").withColumn("epochs", F.lit(0).cast("long")).withColumn("_more", F.lit(False))
    return edge.unionByName(clear).select(*columns).unionByName(none.select(*columns))


def plan(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each row is taken: the row's key, leaf, tokens and ``copies``.

    Tokens are the text's words; rows without any are never taken. A leaf takes all its
    rows ``budget div tokens`` times, and those whose prefix sum in the next epoch's
    order stays within what is left once more. Prefix sums run over hash ranges: only
    sums by range meet per leaf, and rows meet only in the one range that the cut falls
    into, so a leaf with a third of all rows is spread over all tasks. Rows that look
    alike (same key and text) are ordered as they come. An empty table gives none.
    """
    copies = (F.col("epochs") + F.col("_more").cast("long")).alias("copies")
    return _planned(docs, mix, key, text).select(F.col("_key").alias(key), *LEVELS, "tokens", copies)


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as the plan takes it (perhaps never), whatever its columns' names.

    Decisions are joined by key, text and leaf. Rows alike in all of them, null keys
    among them, are as many as the plan has, so they take its copies between them: only
    where the cut goes through such a group are its rows numbered, which spreads even one
    that holds most of the rows.
    """
    same = ["_key", "_text", "lang", "source"]
    taken = materialize(
        _planned(docs, mix, key, text).groupBy(*same).agg(F.first("epochs").alias("_epochs"), F.sum(F.col("_more").cast("long")).alias("_once"), F.count(F.lit(1)).alias("_rows"))
        .filter((F.col("_epochs") > 0) | (F.col("_once") > 0)),
        "mix-taken",
    )
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_text"), F.col("lang"), F.col("source"))

    def written(found: DataFrame, copies: Column) -> DataFrame:
        repeated = found.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_epoch"))
        return repeated.select("_row.*")

    whole = (F.col("_once") == 0) | (F.col("_once") == F.col("_rows"))
    out = written(join_on(rows, taken.filter(whole), same), F.col("_epochs") + F.least(F.col("_once"), F.lit(1)))
    split = taken.filter(~whole)
    if split.isEmpty():
        return out
    parted = materialize(join_on(rows, split, same).withColumn("_id", F.monotonically_increasing_id()), "mix-split")
    numbered = number_rows(parted, same, ["_id"], "_n").withColumn("_copies", F.col("_epochs") + (F.col("_n") < F.col("_once")).cast("long"))
    return out.unionByName(written(numbered.filter("_copies > 0"), F.col("_copies")))
