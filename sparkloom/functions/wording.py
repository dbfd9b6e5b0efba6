"""Texts of the search documents, one template for each kind."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import plain_number

# How each kind of document is worded.
COMP = "{name} 조합(티어 {tier}): 평균 등수 {place}, 승률 {win}, 픽률 {play}. 구성: {members}. {style}{notice}"
PLAYSTYLE = "{name} 조합 플레이 스타일: {style}{notice}"
AUGMENT = "{name}({tier} 등급) 증강체: {description}"
CHAMPION = "{name}({cost}코스트) 챔피언. 특성: {traits}."
ITEM = "{name}: {description}"
ITEM_STATS = "{name}: {description} (스탯: {stats})"
ITEM_BUILD = "{name} 아이템 빌드: {items}. 승률 {win}, 픽률 {play}, 평균 등수 {place}"
UNKNOWN, CARRY = "정보 없음", "(캐리)"


def filled(template: str, **values: Column) -> Column:
    """The template with a column for each name in braces; null if one of them is null."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [values[name].cast("string")] if name else []
    return F.concat(*parts)


def percent(x: Column) -> Column:
    """A share as percent with one digit, rounded from its binary value."""
    return F.concat(plain_number(x * 100, 1), F.lit("%"))


def listing(names: Column) -> Column:
    """Names joined by commas, or the word for unknown if there are none."""
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(UNKNOWN))


def _notice(active: Column, notice: str) -> Column:
    return F.when(active, F.lit("")).otherwise(F.lit(notice))


def comp(name: Column, tier: Column, place: Column, win: Column, play: Column, members: Column, style: Column, active: Column, notice: str) -> Column:
    """``members`` has structs of name and is_carry; an unknown win rate is told as such."""
    names = F.transform(members, lambda m: F.when(m["is_carry"], F.concat(m["name"], F.lit(CARRY))).otherwise(m["name"]))
    win_text = F.coalesce(percent(win), F.lit(UNKNOWN))
    return filled(COMP, name=name, tier=tier, place=plain_number(place, 2), win=win_text, play=percent(play), members=F.array_join(names, ", "), style=style, notice=_notice(active, notice))


def playstyle(name: Column, style: Column, active: Column, notice: str) -> Column:
    return filled(PLAYSTYLE, name=name, style=style, notice=_notice(active, notice))


def augment(name: Column, tier: Column, description: Column) -> Column:
    return filled(AUGMENT, name=name, tier=tier, description=description)


def champion(name: Column, cost: Column, traits: Column) -> Column:
    return filled(CHAMPION, name=name, cost=cost, traits=listing(traits))


def item(name: Column, description: Column, stats: Column) -> Column:
    """With its stat lines, if there are any."""
    with_stats = filled(ITEM_STATS, name=name, description=description, stats=stats)
    return F.when(stats != "", with_stats).otherwise(filled(ITEM, name=name, description=description))


def item_build(name: Column, items: Column, win: Column, play: Column, place: Column) -> Column:
    return filled(ITEM_BUILD, name=name, items=listing(items), win=percent(win), play=percent(play), place=plain_number(place, 2))
