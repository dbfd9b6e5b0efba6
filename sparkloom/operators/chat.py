"""Turns of conversations: history, cached answers, the branch that answers a question, prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t


def exchanges(messages: DataFrame, session: str, turn: str, role: str, text: str, n: int = 3, asker: str = "user", replier: str = "assistant") -> DataFrame:
    """One row per question: session, turn, question, answer, first_turn, last_answer, history.

    The answer is the reply right after the question (null if there is none), history the
    ``n`` exchanges before it, oldest first. Both windows share one shuffle by session.
    """
    ordered = Window.partitionBy(session).orderBy(turn)
    reply = F.when(F.lead(role).over(ordered) == replier, F.lead(text).over(ordered))
    asked = messages.select(session, turn, role, F.col(text).alias("question"), reply.alias("answer")).filter(F.col(role) == asker)
    before = F.collect_list(F.struct("question", "answer")).over(ordered.rowsBetween(-n, -1))
    return asked.select(
        session, turn, "question", "answer", (F.row_number().over(ordered) == 1).alias("first_turn"), F.lag("answer").over(ordered).alias("last_answer"), before.alias("history")
    )


def with_cached(questions: DataFrame, question: str, version: Column, cache: DataFrame, out: str = "cached") -> DataFrame:
    """``questions`` with the answer that ``cache`` (key, answer; keys are distinct) holds under their key."""
    hits = cache.select(F.col("key").alias("_key"), F.col("answer").alias(out))
    return questions.join(hits, t.cache_key(F.col(question), version) == F.col("_key"), "left").drop("_key")


def chosen_intent(keyword: Column, classified: Column, allowed: Sequence[str], otherwise: str = "general") -> Column:
    """What the keywords tell, else the classifier's answer if it is a known one, else ``otherwise``."""
    return F.coalesce(keyword, F.when(classified.isin(*allowed), classified), F.lit(otherwise))


def answer_branch(
    question: Column, *, meta: Column, foreign: Column, off_topic: Column, confirmed: Column, version: Column, asks_version: Column, topics: Column,
    first_turn: Column, cached: Column, intent: Column, last_ids: Column, direct: Mapping[str, str], follow_up: str,
) -> Column:
    """Name of the branch that answers a question; the first that holds, in this order.

    clarify (empty question), meta, language_notice, refusal (off topic and confirmed; a
    confirmation that failed is null and lets pass), no_version, version, multi_topic (two
    topics or more), cached (first turns only), a branch of ``direct`` by intent, lookup
    (``follow_up`` intent and ids in the last answer), and search. Null conditions do not hold.
    """
    steps = [
        ("meta", meta), ("language_notice", foreign), ("refusal", off_topic & confirmed), ("no_version", version.isNull()), ("version", asks_version),
        ("multi_topic", F.size(topics) >= 2), ("cached", first_turn & cached.isNotNull()), *[(name, intent == i) for i, name in direct.items()],
        ("lookup", (intent == follow_up) & ~first_turn & (F.size(last_ids) > 0)),
    ]
    return t.route(question, steps, "search")


def cacheable(first_turn: Column, fallback: Column, documents: Column) -> Column:
    """Whether an answer may be cached: on a first turn, no fallback, made from documents."""
    return F.coalesce(first_turn & ~fallback & (F.size(documents) > 0), F.lit(False))


def prompt(sections: Sequence[tuple[str, Column]], question: Column) -> Column:
    """Headed sections of lines (arrays of strings), then the question; empty and null sections are left out."""
    parts = [F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(f"[{title}]"), lines)) for title, lines in sections]
    return F.concat_ws("\n\n", *parts, question)


def follow_up_prompt(base: Column, kinds: Column, narrative: Sequence[str], rule: Column) -> Column:
    """The instruction for follow-up questions; with a rule against asking for reasons unless a narrative kind of document was found."""
    told = F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in narrative])), F.lit(False))
    return F.when(told, base).otherwise(F.concat(base, rule))
