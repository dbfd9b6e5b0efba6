"""Host-level quality rules.

Document signals are counted inside each row with array functions (no shuffle of
words). Rule failures are then aggregated by host, each host's failure rate is
shrunk towards the corpus rate with a beta prior fitted to all hosts by the method
of moments. A host is judged against that prior: where the odds of a failure are a
multiple of the prior's, all its documents go; where they are above the prior's at all,
its documents must pass the stricter rules too. The verdict is joined back to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import let, materialize, words

#: A rate must be above another by so much: sums come in any order.
CLOSE = 1e-9


@dataclass(frozen=True)
class QualityRules:
    """Limits of the document rules, and of a host's failure odds over the prior's.

    Words and repeats are the base rules; symbols and repeated lines the stricter ones.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    max_host_odds: float = 2.0


def host_of(source: Column) -> Column:
    """Host of a URL, lower-cased and without ``www.``; any other source is its own host."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(F.trim(F.when(host != "", host).otherwise(source))), r"^www\.", "")


def _repeat_words(w: Column, n: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more.

    Each window is hashed to 64 bits. To find equal hashes, the hashes are sorted
    with the window's position in their low bits; a neighbour with the same full
    hash is a repeat. Of the windows found, in order of position, each adds three
    words, less its overlap with the next one.
    """

    def repeats(h: Column) -> Column:
        low = F.pow(F.lit(2.0), F.length(F.bin(F.size(h).cast("long")))).cast("long") - 1
        return let(low, lambda mask: let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))), lambda s: covered(h, s, mask)))

    def covered(h: Column, s: Column, mask: Column) -> Column:
        at = lambda v: F.get(h, v.bitwiseAND(mask).cast("int"))
        same = lambda x, v: F.coalesce(at(v) == x, F.lit(False))
        found = F.transform(s, lambda v, k: let(at(v), lambda x: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), v.bitwiseAND(mask))))
        return let(
            F.sort_array(F.array_compact(found)),
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")),
                lambda a: a["n"],
            ),
        )

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats(h)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(counted)


def signals(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs).

    Null and empty texts have no words and all signals 0.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: let(
            F.size(w),
            lambda n: F.struct(
                n.cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                _repeat_words(w, n).alias("n_repeat_words"),
            ),
        ),
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by the beta prior.

    ``judged`` has ``_host`` and the boolean ``_failed``. The prior's mean is the
    corpus rate; its strength follows from how much more the hosts' rates differ
    than chance would make them. If they differ no more, every host gets the mean; if
    they differ as much as rates can, or more, the strength is 0 and each host keeps its own.
    """
    hosts = materialize(
        judged.filter(F.col("_host").isNotNull()).groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("_failed").cast("long")).alias("host_failures")),
        "quality-hosts",
    )
    n, f = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn"), F.count(F.lit(1)).cast("double").alias("k"))
    mean = F.when(F.col("n") > 0, F.col("f") / F.col("n"))
    chance = F.col("p") * (1 - F.col("p"))
    spread = (F.col("ffn") - F.col("n") * F.col("p") * F.col("p") - (F.col("k") - 1) * chance) / (F.col("n") - F.col("nn") / F.col("n"))
    fitted = (
        sums.withColumn("p", mean)
        .withColumn("v", F.when(F.col("n") > F.col("nn") / F.col("n"), spread))
        .withColumn("m", F.when(F.col("v") > 0, F.greatest(chance / F.col("v") - 1, F.lit(0.0))))
    )
    # One row with two numbers, whatever the number of hosts.
    prior = fitted.select("p", "m").first()
    p, m = prior["p"], prior["m"]
    if p is None:
        shrunk = F.lit(None).cast("double")
    elif m is None:
        shrunk = F.lit(float(p))
    else:
        shrunk = (f + float(p * m)) / (n + float(m))
    return hosts.withColumn("host_fail_rate", shrunk).withColumn("prior_rate", F.lit(p).cast("double"))


def verdicts(judged: DataFrame, rules: QualityRules) -> DataFrame:
    """:func:`host_rates` with ``verdict``: ``bad``, ``watched`` or ``good``."""
    r, p = F.col("host_fail_rate"), F.col("prior_rate")
    verdict = F.when(r * (1 - p) > rules.max_host_odds * p * (1 - r) + CLOSE, F.lit("bad")).when(r > p + CLOSE, F.lit("watched")).otherwise(F.lit("good"))
    return host_rates(judged).withColumn("verdict", verdict)


def _failures(rules: QualityRules, s: Column) -> tuple[Column, Column]:
    """Whether a row's signals fail the base rules, and any rules."""
    n = s["n_words"]
    base = (n < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_percent * n)
    more = (100 * s["n_symbols"] > rules.max_symbol_percent * s["word_chars"]) | (100 * s["n_dup_lines"] > rules.max_dup_line_percent * n)
    return base, base | more


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Signals, document verdict and host verdict of every row.

    Returns key, the five signals, ``base_failed``, ``kept``, ``host``,
    ``host_fail_rate`` and ``host_verdict``. A row is kept if it passes the base rules,
    its host is not bad, and, on a watched host, it passes the stricter rules as well. A
    row without a source has no host: it counts for none and its base rules decide. Null
    and empty texts have no words and fail. Rows are judged one by one, so repeated rows
    and null keys come back as often as they came in; an empty table gives none.
    """
    base, failed = _failures(rules, F.col("_s"))
    rated = docs.select(F.col(key).alias("_key"), host_of(F.col(source)).alias("_host"), signals(F.col(text)).alias("_s"))
    judged = materialize(rated.withColumn("base_failed", base).withColumn("_failed", failed), "quality-signals")
    hosts = verdicts(judged, rules).select("_host", "host_fail_rate", "verdict")
    strict = F.coalesce(F.col("verdict") == "bad", F.lit(False)) | (F.coalesce(F.col("verdict") == "watched", F.lit(False)) & F.col("_failed"))
    return judged.join(hosts, "_host", "left").select(
        F.col("_key").alias(key), "_s.*", "base_failed", (~F.col("base_failed") & ~strict).alias("kept"),
        F.col("_host").alias("host"), "host_fail_rate", F.col("verdict").alias("host_verdict"),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, whatever their names.

    Signals are counted once: rows that pass the base rules are written down beside
    their flags, all others as flags alone. Only the hosts to look out for are joined to
    the texts, and to those of watched hosts only rows that fail the stricter rules.
    """
    base, failed = _failures(rules, F.col("s"))
    flagged = materialize(
        docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), host_of(F.col(source)).alias("_host"), signals(F.col(text)).alias("s"))
        .select(F.when(~base, F.col("row")).alias("row"), "_host", failed.alias("_failed")),
        "quality-flagged",
    )
    odd = materialize(verdicts(flagged, rules).filter("verdict != 'good'").select("_host", "verdict"), "quality-hosts-to-watch")
    passed = flagged.filter(F.col("row").isNotNull())
    clean = passed.filter(~F.col("_failed")).join(odd.filter("verdict = 'bad'"), "_host", "left_anti")
    doubtful = passed.filter("_failed").join(odd, "_host", "left_anti")
    return clean.unionByName(doubtful).select("row.*")
