"""Likeness of weighted sets and shares of multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranges import written


#: Pairs of one element that a task lists at most, about.
PAIRS = 1 << 20
#: Left sets from which on an element is put behind rarer ones, and elements that travel with a posting.
COMMON, TAIL = 64, 64


def _meeting(left: DataFrame, right: DataFrame, left_id: str, right_id: str, element: str, at_once: int) -> DataFrame:
    """Rows of ``left`` and ``right`` with the same element; an element of more than ``at_once`` pairs is dealt to several tasks."""
    counts = lambda df, n: df.groupBy(element).agg(F.count(F.lit(1)).alias(n))
    needed = F.ceil(F.col("_l") * F.col("_r") / F.lit(float(at_once))).cast("long")
    hot = counts(left, "_l").join(counts(right, "_r"), element).select(element, F.least(needed, F.col("_l")).cast("int").alias("_deals")).filter("_deals > 1")
    deals = F.coalesce("_deals", F.lit(1))
    dealt = left.join(hot, element, "left").withColumn("_deal", F.pmod(F.xxhash64(left_id), deals).cast("int")).drop("_deals")
    every = right.join(hot, element, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return dealt.join(every, [element, "_deal"]).drop("_deal")


def _rare_part(left: DataFrame, right: DataFrame, right_id: str, element: str, weight: str, least: float) -> DataFrame:
    """The rarest elements of each right set, so many that the others weigh less than ``least`` of the set.

    Elements are ordered by the power of two of the left sets that have them, so a set is
    summed over 63 classes at most, never sorted whole.
    """
    known = right.join(left.groupBy(element).agg(F.floor(F.log2(F.count(F.lit(1)))).alias("_class")), element)
    whole = right.groupBy(right_id).agg(F.sum(weight).alias("_whole"))
    commoner = Window.partitionBy(right_id).orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = known.groupBy(right_id, "_class").agg(F.sum(weight).alias("_w")).withColumn("_rest", F.sum("_w").over(commoner))
    needed = rest.join(whole, right_id).filter(F.col("_rest") >= F.col("_whole") * least - 1e-9)
    return known.join(needed.select(right_id, "_class"), [right_id, "_class"], "left_semi").select(right_id, element)


def _postings(sets: DataFrame, ident: str, element: str, classes: DataFrame, side: str, weight: str | None = None) -> DataFrame:
    """Each element of a set with what comes after it in the set: rarer elements come first.

    Columns ``{side}n`` (the set's size), ``{side}after`` (elements that follow) and
    ``{side}tail`` (the first ``TAIL`` of them); with a weight also ``_w``, ``_whole``,
    ``_rest`` (the weight that follows) and ``_weights`` (of the tail).
    """
    placed = sets.filter(F.col(ident).isNotNull()).join(classes, element, "left").withColumn("_class", F.coalesce("_class", F.lit(0)))
    line = Window.partitionBy(ident).orderBy("_class", element)
    every, here, tail = (line.rowsBetween(*x) for x in ((Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, 0), (1, TAIL)))
    one = F.lit(1)
    columns = {f"{side}n": F.count(one).over(every), "_at": F.count(one).over(here), f"{side}tail": F.collect_list(element).over(tail)}
    if weight is not None:
        placed = placed.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
        columns |= {"_whole": F.sum("_w").over(every), "_run": F.sum("_w").over(here), "_weights": F.collect_list("_w").over(tail)}
    rows = placed.withColumns(columns).filter(F.col(element).isNotNull()).withColumn(f"{side}after", F.col(f"{side}n") - F.col("_at"))
    kept = [element, ident, f"{side}n", f"{side}after", f"{side}tail"]
    return rows.select(*kept) if weight is None else rows.select(*kept, "_w", "_whole", (F.col("_whole") - F.col("_run")).alias("_rest"), "_weights")


def _alike(left: DataFrame, right: DataFrame, left_id: str, right_id: str, element: str, weight: str, least: float, at_once: int) -> DataFrame:
    """left_id, right_id, similarity of the pairs that reach ``least`` (above 0).

    Sets are ordered rarer elements first. Where two sets meet in an element, the tails
    that travel with it tell all that they share from there on. That is everything at
    the first element they share and less at the others, so the greatest is the pair's
    similarity, and only pairs that reach ``least`` leave the task in which they meet. A
    pair with a tail that is cut off is measured by joins instead.
    """
    counts = lambda df, n: df.groupBy(element).agg(F.count(F.lit(1)).alias(n))
    common = written(counts(left, "_l").join(counts(right, "_r"), element).filter((F.col("_l") > COMMON) | (F.col("_l").cast("double") * F.col("_r") > at_once)), "common")
    classes = common.select(element, F.floor(F.log2("_l")).cast("int").alias("_class"))
    # A shade below the least, for what sums of weights lose.
    near, after = least * (1 - 1e-9), F.col("_w") + F.col("_rest")
    a = _postings(left.select(left_id, element), left_id, element, classes, "_l")
    b = _postings(right.select(right_id, element, weight), right_id, element, classes, "_r", weight).filter(after >= near * F.col("_whole"))
    if common.filter(F.col("_l").cast("double") * F.col("_r") > at_once).isEmpty():
        met = a.join(b, element)
    else:
        met = _meeting(written(a, "postings"), written(b, "postings"), left_id, right_id, element, at_once)
    cut = (F.col("_lafter") > TAIL) | (F.col("_rafter") > TAIL)
    alone = F.col("_whole") + F.col("_ln") - 1
    able = (after >= near * (alone - F.least("_lafter", "_rafter"))) & ((F.col("_w") >= near * alone) | cut | F.arrays_overlap("_ltail", "_rtail"))
    shared = F.zip_with("_rtail", "_weights", lambda e, w: F.when(F.array_contains("_ltail", e), w).otherwise(0.0))
    sw, rest = F.aggregate(shared, F.col("_w"), lambda x, y: x + y), alone - F.size(F.array_intersect("_ltail", "_rtail"))
    measured = met.filter(able).select(left_id, right_id, F.when(~cut & (rest > 0), sw / rest).alias("similarity"), cut.alias("_cut"))
    found = written(measured.filter(F.col("_cut") | (F.col("similarity") >= least)), "alike")
    whole = found.groupBy(left_id, right_id).agg(F.max("similarity").alias("similarity"), F.bool_or("_cut").alias("_cut"))
    if found.filter("_cut").isEmpty():
        return whole.select(left_id, right_id, "similarity")
    pairs = found.filter("_cut").select(left_id, right_id).distinct()
    met = pairs.join(right.select(right_id, element, weight), right_id).join(left.select(left_id, element), [left_id, element])
    return whole.filter(~F.col("_cut")).select(left_id, right_id, "similarity").unionByName(_measured(met, left, right, left_id, right_id, weight).filter(F.col("similarity") >= least))


def _measured(met: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, weight: str) -> DataFrame:
    """Similarity of pairs of which ``met`` has a row for each shared element."""
    left_size = left.groupBy(left_id).agg(F.count(F.lit(1)).alias("_ln"))
    right_size = right.groupBy(right_id).agg(F.sum(weight).alias("_rw"))
    shared = met.groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("_k"), F.sum(weight).alias("_w"))
    joined = shared.join(left_size, left_id).join(right_size, right_id)
    return joined.select(left_id, right_id, (F.col("_w") / (F.col("_rw") + F.col("_ln") - F.col("_k"))).alias("similarity"))


def weighted_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, element: str, weight: str, least: float = 0.0, at_once: int = PAIRS) -> DataFrame:
    """left_id, right_id, similarity of every two sets that share an element and reach ``least``.

    An element weighs what the right set says (0 or more), and 1 if only the left set has
    it. Each set holds an element once; null elements are shared by none. Sets without a
    common element (similarity 0) make no row, so no pair is formed that no element asks for.

    With ``least`` above 0 pairs are measured where they meet, in each element that they
    share and that can still bring them to ``least`` (``_alike``); only those that
    reach it are shuffled. Without it every sharing pair is asked for. Either way the
    pairs of one element are listed ``at_once`` to a task, about.
    """
    if least > 0:
        return _alike(left, right, left_id, right_id, element, weight, least, at_once)
    met = _meeting(left.select(left_id, element), right.select(right_id, element, weight), left_id, right_id, element, at_once)
    return _measured(met, left, right, left_id, right_id, weight)


def best_match(pairs: DataFrame, left_id: str, right_id: str, bins: Sequence[float] = (0.3, 0.6)) -> DataFrame:
    """The most similar right set of each left set (ties: smallest id), its deviation and bin."""
    best = pairs.groupBy(left_id).agg(F.max_by(F.struct(right_id, "similarity"), F.struct(F.col("similarity"), -F.col(right_id))).alias("_b")).select(left_id, "_b.*")
    deviation = 1 - F.col("similarity")
    level = sum((deviation >= b).cast("int") for b in bins)
    return best.withColumn("deviation", deviation).withColumn("bin", level)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null on a whole of 0."""
    return F.when(whole != 0, part / whole)


def multiset_overlap(a: DataFrame, b: DataFrame, element: str) -> DataFrame:
    """One row, ``common``: the size of the intersection, duplicates counted one by one."""
    counts = a.groupBy(element).agg(F.count(F.lit(1)).alias("_a")).join(b.groupBy(element).agg(F.count(F.lit(1)).alias("_b")), element)
    return counts.agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0)).alias("common"))


def multiset_overlaps(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, element: str) -> DataFrame:
    """``pairs`` (left_id, right_id) with ``common``, the size of the two multisets' intersection; 0 for none.

    Only the pairs given are formed; equal elements of a set are counted before they are joined.
    """
    counts = lambda df, ident, n: df.groupBy(ident, element).agg(F.count(F.lit(1)).alias(n))
    both = pairs.join(counts(left, left_id, "_a"), left_id).join(counts(right, right_id, "_b"), [right_id, element])
    common = both.groupBy(left_id, right_id).agg(F.sum(F.least("_a", "_b")).alias("common"))
    return pairs.join(common, [left_id, right_id], "left").select(left_id, right_id, F.coalesce("common", F.lit(0)).alias("common"))


def concentration(df: DataFrame, by: Sequence[str], chosen: Column, out: str = "concentration") -> DataFrame:
    """Per ``by`` the share of rows that are ``chosen``; null chosen rows count as not chosen."""
    return df.groupBy(*by).agg(share(F.count(F.when(chosen, 1)), F.count(F.lit(1))).alias(out))
