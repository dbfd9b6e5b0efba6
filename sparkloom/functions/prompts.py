"""What a model is sent for a question, by the branch that answers it: sections, then the message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import allowed_host

#: Headings and sentences as the model knows them (fixed values).
DOCUMENTS, NO_DOCUMENTS = "[검색된 문서] (기준 패치: {})", "(검색된 문서 없음)"
WEB, NO_WEB = "[웹 검색 결과]", "(검색된 결과 없음)"
TRUSTED, UNTRUSTED, SOURCE = "[공식/전문]", "[커뮤니티/미검증]", " (출처: {})"
HISTORY, TOPICS = "[이전 대화]", "[요청된 주제]"
FACTS, TODAY = "[알려진 사실]\n현재 서비스에 반영된 기준 패치는 '{}' 패치입니다.", "\n오늘 날짜는 {}입니다."


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _listed(header: Column, lines: Column, none: str) -> Column:
    return F.concat_ws("\n", header, F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(none)))


def documents_section(version: Column, texts: Column) -> Column:
    """The texts found, a list item each, under the version; says so if there are none."""
    return _listed(_filled(DOCUMENTS, version), F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.concat(F.lit("- "), t)), NO_DOCUMENTS)


def web_section(results: Column, trusted: Sequence[str]) -> Column:
    """Web results (structs of title, content, url), each marked by whether its host is trusted."""
    mark = lambda r: F.when(allowed_host(r["url"], trusted), F.lit(TRUSTED)).otherwise(F.lit(UNTRUSTED))
    return _listed(F.lit(WEB), F.transform(results, lambda r: F.concat(F.lit("- "), mark(r), F.lit(" "), r["title"], F.lit(": "), r["content"], _filled(SOURCE, r["url"]))), NO_WEB)


def history_section(history: Column) -> Column:
    """Earlier exchanges (structs of question, answer); null if there are none, which leaves the section out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform(history, lambda x: F.concat(F.lit("Q: "), text(x["question"]), F.lit("\nA: "), text(x["answer"])))
    return F.when(F.size(history) > 0, F.concat_ws("\n", F.lit(HISTORY), F.array_join(lines, "\n")))


def facts_section(version: Column, today: Column | None = None) -> Column:
    """The current version, and the date if there is one; null without a version."""
    said = _filled(FACTS, version)
    return said if today is None else F.concat(said, F.coalesce(_filled(TODAY, today), F.lit("")))


def topics_section(labels: Column) -> Column:
    return F.concat(F.lit(TOPICS + "\n"), F.array_join(labels, ", "))


def message_turn(branch: Column, message: Column, version: Column, texts: Column, results: Column, history: Column, topics: Column, trusted: Sequence[str], today: Column | None = None) -> Column:
    """What is sent for a question: by ``branch`` documents, web results, topics, or earlier exchanges only; null where no model is asked."""
    turn = lambda *sections: F.concat_ws("\n\n", *sections, message)
    earlier = history_section(history)
    return (
        F.when(branch.isin("search", "lookup"), turn(documents_section(version, texts), earlier))
        .when(branch == "web_search", turn(facts_section(version, today), web_section(results, trusted), earlier))
        .when(branch == "model_only", turn(earlier))
        .when(branch == "multi_topic", turn(topics_section(topics)))
    )
