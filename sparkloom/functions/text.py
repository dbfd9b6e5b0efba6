"""Cleaning, normalising, routing and grounding of short texts, all as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Unicode white space cut off on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_markup(text: Column, placeholder: str = "?") -> Column:
    """Line-break tags to newlines, ``@...@`` to a placeholder, other tags out, at most one blank line.

    A tag has a letter after ``<`` or ``</``; comparisons and arrows stay.
    """
    broken = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    filled = F.regexp_replace(broken, r"@[^@]*@", placeholder)
    return strip(F.regexp_replace(F.regexp_replace(filled, r"</?[a-zA-Z][^<>]*>", ""), r"\n{3,}", "\n\n"))


def fill_glossary(text: Column, glossary: Mapping[str, str]) -> Column:
    """``{{KEY}}`` replaced by the glossary, unknown keys by nothing."""
    known = reduce(lambda c, item: F.replace(c, F.lit("{{" + item[0] + "}}"), F.lit(item[1])), glossary.items(), text)
    return F.regexp_replace(known, r"\{\{[^{}]+\}\}", "")


def asset_url(path: Column, base: str) -> Column:
    """Base and lower-cased path, ``.tex`` written ``.png``; null stays null."""
    return F.concat(F.lit(base), F.replace(F.lower(path), F.lit(".tex"), F.lit(".png")))


def name_or_fallback(key: Column, names: Column, prefix: str) -> Column:
    """The mapped name, or the key without the prefix pattern."""
    return F.coalesce(names[key], F.regexp_replace(key, f"(?i){prefix}", ""))


def normalize_query(text: Column, terms: Mapping[str, str], limit: int = 500) -> Column:
    """Blanks squeezed, short forms written out in order (unless the full form is there), cut to ``limit`` code points."""
    squeezed = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    full = reduce(lambda c, item: F.when(c.contains(item[1]), c).otherwise(F.replace(c, F.lit(item[0]), F.lit(item[1]))), terms.items(), squeezed)
    return F.substring(full, 1, limit)


def first_topic(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern that the text matches, else null."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules])


def all_topics(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of all patterns that the text matches, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules]))


def single_topic(text: Column, rules: Sequence[tuple[str, str]], unless: str | None = None) -> Column:
    """The label if exactly one pattern matches and ``unless`` does not, else null."""
    found = all_topics(text, rules)
    clear = F.size(found) == 1 if unless is None else (F.size(found) == 1) & ~text.rlike(unless)
    return F.when(clear, F.get(found, F.lit(0)))


def foreign(text: Column, own_script: str = "가-힣", words: int = 3) -> Column:
    """No letter of the own script, and ``words`` Latin words or more."""
    return ~text.rlike(f"[{own_script}]") & (F.regexp_count(text, F.lit("[A-Za-z]+")) >= words)


def route(text: Column, steps: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first step whose condition holds; an empty text asks for clarification."""
    chain = F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit("clarify"))
    return reduce(lambda c, s: c.when(F.coalesce(s[1], F.lit(False)), F.lit(s[0])), steps, chain).otherwise(F.lit(otherwise))


def quoted(text: Column) -> Column:
    """What stands in single quotes, in order."""
    return F.regexp_extract_all(text, F.lit("'([^'\n]+)'"), F.lit(1))


def ungrounded(text: Column, known: Column, pattern: str = "'([^'\n]+)'") -> Column:
    """Distinct pattern matches that ``known`` lacks."""
    return F.array_except(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), known)


def warn_ungrounded(text: Column, known: Column, warning: str) -> Column:
    """The text, with a warning after it if it quotes an unknown name."""
    return F.when(F.size(ungrounded(text, known)) > 0, F.concat(text, F.lit("\n\n" + warning))).otherwise(text)


def mask_rate(text: Column, subject: str, mask: str) -> Column:
    """A percentage after the subject and up to ten characters, none a ``%`` or newline, replaced by a mask."""
    return F.regexp_replace(text, rf"{subject}[^%\n]{{0,10}}\d+(?:\.\d+)?%", mask)


def drop_markers(text: Column, markers: Sequence[str], citation: str) -> Column:
    """Internal markers, and then every empty ``citation`` pattern, taken out; texts without a marker untouched."""
    has = reduce(Column.__or__, [text.contains(m) for m in markers])
    bare = reduce(lambda c, m: F.replace(c, F.lit(m), F.lit("")), markers, text)
    return F.when(has, F.regexp_replace(F.regexp_replace(bare, citation, ""), r"(?U)\s+$", "")).otherwise(text)


def mask_names(text: Column, names: Sequence[str], mask: str) -> Column:
    """Every literal name replaced by the mask, longest first."""
    return reduce(lambda c, n: F.replace(c, F.lit(n), F.lit(mask)), sorted(filter(None, names), key=len, reverse=True), text)


def ids_in_order(text: Column, pattern: str) -> Column:
    """Distinct integers that the pattern's group finds, in order of appearance."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda x: x.cast("long"))


def host(url: Column) -> Column:
    """Lower-cased host without port and ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def allowed_host(url: Column, hosts: Sequence[str]) -> Column:
    """Whether the host is one of ``hosts`` or below one."""
    return reduce(Column.__or__, [(host(url) == h) | host(url).endswith("." + h) for h in hosts], F.lit(False))


def tokens_subset(text: Column, evidence: Column, pattern: str) -> Column:
    """Whether every match in the text is also a match in the evidence."""
    of = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.size(F.array_except(of(text), of(evidence))) == 0


def cache_key(*columns: Column) -> Column:
    """SHA-256 of the columns joined by a bar."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def plain_number(x: Column, digits: int) -> Column:
    """Fixed-point text rounded on the exact binary value, without group commas."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def stat_lines(stats: Column, known: Sequence[tuple[str, str, str]]) -> Column:
    """``label value`` of the known keys of a number map, in the given order, joined by commas.

    ``known``: key, label and unit (``flat``, ``percent``, ``fraction``: times 100).
    """

    def one(key: str, label: str, unit: str) -> Column:
        number = F.regexp_replace(plain_number(stats[key] * (100 if unit == "fraction" else 1), 1), r"\.0$", "")
        return F.when(stats[key].isNotNull(), F.concat(F.lit(label + " "), number, F.lit("" if unit == "flat" else "%")))

    return F.array_join(F.array_compact(F.array(*[one(*k) for k in known])), ", ")


def follow_ups(text: Column, n: int = 1) -> Column:
    """First ``n`` lines that are not blank, without bullets."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(strip(x), r"^[-*•\d.)\s]+", ""))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def sse_frames(words: Column, follow_ups: Column | None = None) -> Column:
    """Server-sent event frames: emitted words, newlines escaped; follow-up questions as a JSON list, if there are any; ``done``."""
    frames = F.array_join(F.transform(words, lambda w: F.concat(F.lit("data: "), F.replace(w, F.lit("\n"), F.lit("\\n")), F.lit("\n\n"))), "")
    last = F.lit("event: done\ndata: [DONE]\n\n")
    if follow_ups is None:
        return F.concat(frames, last)
    asked = F.when(F.size(follow_ups) > 0, F.concat(F.lit("event: followups\ndata: "), F.to_json(follow_ups), F.lit("\n\n"))).otherwise("")
    return F.concat(frames, asked, last)


def parse_sse(body: Column) -> Column:
    """Structs of event and data of a body of frames; the event is ``message`` unless named."""
    frames = F.filter(F.split(body, "\n\n"), lambda x: x.contains("data:"))
    kind = lambda x: F.when(x.rlike("(?m)^event: "), F.regexp_extract(x, r"(?m)^event: (.*)$", 1)).otherwise("message")
    return F.transform(frames, lambda x: F.struct(kind(x).alias("event"), F.replace(F.regexp_extract(x, r"(?m)^data: ?(.*)$", 1), F.lit("\\n"), F.lit("\n")).alias("data")))


def wrapped(text: Column, start: str, end: str) -> Column:
    """The text between two delimiter lines."""
    return F.concat(F.lit(start + "\n"), text, F.lit("\n" + end))


def off_topic(text: Column, keywords: str) -> Column:
    """Whether the text has no keyword of the subject."""
    return ~F.coalesce(text.rlike(keywords), F.lit(False))


def asks_version(text: Column, subject: str, exclude: Sequence[str], signals: Sequence[str], bare: str) -> Column:
    """Whether a text asks for the current version.

    It names the subject and no excluded word; then a signal word decides, or else that
    nothing but the ``bare`` pattern is there once end punctuation is cut off.
    """
    has = lambda words: reduce(Column.__or__, [text.contains(w) for w in words], F.lit(False))
    rest = strip(F.regexp_replace(text, r"[?!？！ ]+$", ""))
    return F.coalesce(F.when(~text.contains(subject) | has(exclude), F.lit(False)).otherwise(has(signals) | rest.rlike(f"^(?:{bare})$")), F.lit(False))


def without_citations(text: Column, markers: Sequence[str], citation: str) -> Column:
    """Citations taken out and blanks squeezed where the text says that it has no information."""
    none = reduce(Column.__or__, [text.contains(m) for m in markers], F.lit(False))
    return F.when(none, strip(F.regexp_replace(F.regexp_replace(text, citation, ""), r"[ \t]+", " "))).otherwise(text)


def warn_unknown_sources(text: Column, known_urls: Column, warning: str, orphan: str, url: str = r"https?://[^\s)\]]+", trailing: str = r"""[.,;:!?)\]'"]+$""") -> Column:
    """The text, with a warning if it has a URL that is not known or a source label without one."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(url), F.lit(0)), lambda u: F.regexp_replace(u, trailing, ""))
    return F.when((F.size(F.array_except(urls, known_urls)) > 0) | text.rlike(orphan), F.concat(text, F.lit("\n\n" + warning))).otherwise(text)


def search_text(query: Column, last_answer: Column) -> Column:
    """The last answer, if there is one, before the query."""
    return F.concat_ws("\n", F.when(last_answer != "", last_answer), query)


def emitted_words(text: Column) -> Column:
    """Words of an answer one by one, each but the last with the blank after it."""
    words = F.split(text, " ", -1)
    return F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "))).otherwise(w))


def postprocessed(text: Column, markers: Sequence[str], citation: str, subject: str, rate_mask: str, names: Sequence[str], name_mask: str, known: Column, warning: str) -> Column:
    """Markers dropped, rates and names masked, then a warning for names that are not known."""
    return warn_ungrounded(mask_names(mask_rate(drop_markers(text, markers, citation), subject, rate_mask), names, name_mask), known, warning)


def playstyle(carries: Column, badges: Column, labels: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Carries joined by ``/`` and the badges that are set, labelled, joined by a middle dot.

    ``badges`` maps badge to text: ``true`` gives the label alone, null and ``false`` nothing.
    """
    shown = [F.when(badges[k] == "true", F.lit(label)).when(badges[k] != "false", F.concat(F.lit(label + " "), badges[k])) for k, label in labels]
    parts = F.array_compact(F.array(F.when(F.size(carries) > 0, F.array_join(carries, "/")), *shown))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(F.lit(otherwise))
