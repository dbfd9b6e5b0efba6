import hashlib
import re
from collections import Counter

import pytest

from sparkloom.llm import positional

DOCS = "doc_id long, text string, terms string, segment long"
LINE = "the quick brown fox jumps over the lazy dog while seven grey owls watch from above"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10, near_terms=4, span=20):
    texts = [(i, words(t)) for i, t in docs]
    tests = [("" if i is None else str(i), words(t)) for i, t in items]
    counts = Counter(w for _, ws in texts for w in ws)
    out = []
    for doc_id, ws in texts:
        hit, found, near = set(), set(), set()
        for item, iw in tests:
            k = min(width, len(iw))
            for at in range(len(iw) - k + 1 if k else 0):
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[at : at + k]:
                        hit |= set(range(p, p + k))
                        found.add(item)
            rare = sorted((w for w in set(iw) if counts[w]), key=lambda w: (counts[w], w.encode()))[:near_terms]
            if len(rare) == near_terms and any(w == rare[0] and set(rare) <= set(ws[max(0, p - span) : p + span + 1]) for p, w in enumerate(ws)):
                near.add(item)
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


ODD_DOCS = [
    (1, f"Before. {LINE}, and after."), (1, f"Before. {LINE}, and after."), (2, None), (3, ""), (None, LINE.upper()), (4, "(ñandú) " * 3 + LINE[:20]),
    (5, f"{LINE} {LINE} " + "filler words " * 1_000 + LINE), (6, "owls above watch seven grey dog lazy"), (7, "hapax legomenon"), (8, "... !!! ---"),
]
ODD_ITEMS = [(10, LINE), (2, "hapax Legomenon"), (2, "lazy dog while"), (3, None), (4, ""), (None, "ñandú"), (10, LINE), (9, f"unseen {LINE[:-6]}"), (11, "word " * 12)]


def run(spark, tmp_path, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    t = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, spans int")
    return sorted(map(tuple, positional.decontaminate(d, t, f"{tmp_path}/index").collect()), key=str)


def test_odd_rows_match_brute_force(spark, tmp_path):
    got = run(spark, tmp_path, ODD_DOCS, ODD_ITEMS)
    assert got == brute(ODD_DOCS, ODD_ITEMS)
    assert {r[0] for r in got if r[5]} == {1, None, 4, 5, 7}


def test_slices_and_pieces_give_the_same_rows(spark, tmp_path, monkeypatch):
    for name, value in (("SLICE_WORDS", 8), ("SEGMENT_BYTES", 100), ("STARTS", 3)):
        monkeypatch.setattr(positional, name, value)
    assert run(spark, tmp_path, ODD_DOCS, ODD_ITEMS) == brute(ODD_DOCS, ODD_ITEMS)


def test_long_items_come_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positional, "PIECE_WORDS", 3)
    drop_near = lambda rows: [r[:-1] for r in rows]  # noqa: E731  (pieces have rare terms of their own)
    assert drop_near(run(spark, tmp_path, ODD_DOCS, ODD_ITEMS)) == drop_near(brute(ODD_DOCS, ODD_ITEMS))


@pytest.mark.parametrize(("docs", "items"), [([], ODD_ITEMS), (ODD_DOCS[:4], []), ([], [])])
def test_empty_tables(spark, tmp_path, docs, items):
    assert run(spark, tmp_path, docs, items) == brute(docs, items)


def test_spans_are_joined_and_the_index_can_be_read_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"x {LINE} y {LINE}")], "doc_id long, text string")
    positional.write_index(docs, f"{tmp_path}/index")
    tests = spark.createDataFrame([(1, LINE)], "item_id long, text string")
    row = positional.search(positional.read_index(spark, f"{tmp_path}/index"), tests).first()
    n = len(words(LINE))
    assert [tuple(s) for s in row["spans"]] == [(1, 1 + n), (2 + n, 2 + 2 * n)]
    assert (row["items"], row["near"]) == (["1"], ["1"])
