import re

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import links

DOCS = "k long, place long, source string, kind string, id long, name string, hero string"


def plain(answer, targets):
    """The same rules, one text at a time."""
    linked = re.sub(r"'([^']+)'", lambda m: f"[{m[1]}]({targets[m[1]]})" if m[1] in targets else m[0], answer)
    return re.sub(r"(?m)^-\s+([^:\n]+?):", lambda m: m[0] if m[1].startswith("[") or m[1].strip() not in targets else f"- [{m[1].strip()}]({targets[m[1].strip()]}):", linked)


def test_first_document_with_a_name_decides(spark):
    rows = [(1, 2, "decks", "deck", 7, "Storm", None), (1, 1, None, "build", 8, "", "Ahri"), (1, 3, None, "hero", 9, "Ahri", "Storm"), (1, 4, None, "odd", 3, "Rune", None), (2, 1, None, "deck", 1, None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    url = links.page_url(F.col("source"), F.col("kind"), F.col("id"), {"decks": "/decks?id={}"}, {"hero": "/heroes/{}/x", "build": "/builds"})
    got = {r["k"]: r["targets"] for r in links.link_targets(docs, ["k"], ["place"], [(F.col("name"), url), (F.col("hero"), url)]).collect()}
    assert got == {1: {"Storm": "/decks?id=7", "Ahri": "/builds", "Rune": "/"}}


def test_links_match_the_plain_rules(spark):
    targets = {"Ahri": "/h/1", "A$1\\b": "/x?y=$0", "Storm Deck": "/d", "Ünı": "/u"}
    answers = [
        "", "no names", "'Ahri' and 'Nobody', 'Ahri'", "it's 'Ahri', isn't it", "- Ahri: a, b\n-   Storm Deck : c\n- Nobody: d\n-Ahri: e\n  - Ahri: f", "- 'Ahri': quoted, then listed",
        "'A$1\\b' '' '", "- Ünı: x", "x - Ahri: y", "'Storm\nDeck'", "- Ahri\n: z", "- [Ahri]: kept", "'Ahri''Ahri'", "-\tAhri: tab\r\n- Ahri: last",
    ]
    df = spark.createDataFrame([(i, a, targets) for i, a in enumerate(answers)] + [(99, "'Ahri'", None), (100, None, targets)], "i int, a string, m map<string,string>")
    got = {r["i"]: r["l"] for r in df.select("i", links.insert_links(F.col("a"), F.col("m")).alias("l")).collect()}
    assert {i: got[i] for i in range(len(answers))} == {i: plain(a, targets) for i, a in enumerate(answers)}
    assert got[99] == "'Ahri'" and got[100] is None


def test_answers_without_documents_stay(spark):
    answers = spark.createDataFrame([(1, "'a'"), (2, "'a'")], "k long, t string")
    docs = spark.createDataFrame([(1, 1, None, "x", 5, "a", None)], DOCS)
    out = links.with_links(answers, docs, ["k"], ["place"], [(F.col("name"), F.concat(F.lit("/"), "id"))], "t", "linked")
    assert {r["k"]: r["linked"] for r in out.collect()} == {1: "[a](/5)", 2: "'a'"}


def test_post_processing_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    mark = lambda s: one(text.drop_markers(F.lit(s), ["[docs]", "[web]"], r"\(\s*see\s*:\s*\)"))
    assert mark("Since 17.8. (see: [docs])  ") == "Since 17.8."
    assert mark("f() [ ] (see: ) ") == "f() [ ] (see: ) " and mark("[web]: f() [ ]") == ": f() [ ]"
    rate = lambda s: one(text.mask_rate(F.lit(s), "rate", "X"))
    assert [rate(s) for s in ("rate: 55.5% up", "rate % 60%", "rate 55 %", "rate\n60%", "rate is rather more than 60%")] == ["X up", "rate % 60%", "rate 55 %", "rate\n60%", "rate is rather more than 60%"]
    assert one(text.clean_markup(F.lit("3 < 5 and 7 > 2, <3 hearts> <b class='x'>x</b> <-"))) == "3 < 5 and 7 > 2, <3 hearts> x <-"
    cited = lambda s: one(text.warn_unknown_sources(F.lit(s), F.array(F.lit("https://a.b/c")), "?", r"\[source\](?!\()"))
    assert all(not cited(s).endswith("\n\n?") for s in ("'https://a.b/c'", "(https://a.b/c).", "[https://a.b/c]", 'say "https://a.b/c";', "none"))
    assert all(cited(s).endswith("\n\n?") for s in ("https://a.b/cd", "https://a.b/c [source]"))
