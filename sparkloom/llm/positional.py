"""Benchmark decontamination with a distributed positional inverted index.

* ``write_index`` stores, for every run of documents (a segment), each term's positions
  in order: the postings. A segment is one row, so documents are never shuffled, and a
  lost task writes its segments anew.
* ``search`` takes the test items' windows. The terms' counts over all segments come
  first. Then, in each segment, a window's postings are intersected from its rarest term
  on: a list of starts, adjusted by the term's offset, is held against the next rarest
  term's list until the window is complete or no start is left. A window with a term
  that a segment lacks costs nothing there.
* Proximity: an item's few rarest terms have to lie near one another, in any order.

Test items go to the tasks in slices of a fixed number of words (one slice is one pass
over the index), so nothing that is sent grows with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.byte_words import cut, runs, separators
from sparkloom.llm.common import lower_ascii, materialize

#: Fixed by the contract: bytes that do not belong to words, and words in a window.
NOT_WORDS = ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WINDOW = 10
#: Text bytes in a segment (one longer text is one segment).
SEGMENT_BYTES = 4 << 20
#: Test words sent at a time, and in one piece of a longer item.
SLICE_WORDS, PIECE_WORDS = 1 << 20, 1 << 12
#: Candidate starts held at a time.
STARTS = 1 << 20

_WORD = separators(*NOT_WORDS)
#: ``LOWER`` lets A-Z pass as a-z, so they count as words here.
_WORD[65:91] = True
_SPACED = separators((0x20, 0x20))

SEGMENT = "segment long, documents array<struct<doc_id:long,n_words:int>>, terms string, counts binary, postings binary"


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of all ``docs`` (doc_id, text) as a Parquet table and return it.

    A row is a segment: its documents in order, its distinct terms (space-joined), how
    often each occurs, and their positions in term order (little-endian 32-bit, counted
    over the segment's words). A null text has no words; an empty table has no segment.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, end in runs(batch.column(1), SEGMENT_BYTES):
                found = cut(batch.column(1).slice(begin, end - begin), _WORD)
                coded = found.words.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                documents = [{"doc_id": i, "n_words": n} for i, n in zip(batch.column(0).slice(begin, end - begin).to_pylist(), found.per_document().tolist(), strict=True)]
                row = {
                    "segment": number,
                    "documents": documents,
                    "terms": " ".join(coded.dictionary.to_pylist()),
                    "counts": np.bincount(codes, minlength=len(coded.dictionary)).astype("<i4").tobytes(),
                    "postings": np.argsort(codes, kind="stable").astype("<i4").tobytes(),
                }
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=_arrow_segment())

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SEGMENT).write.parquet(path)
    return read_index(docs.sparkSession, path)


def _arrow_segment() -> pa.Schema:
    document = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int32())])
    return pa.schema([("segment", pa.int64()), ("documents", pa.list_(document)), ("terms", pa.utf8()), ("counts", pa.binary()), ("postings", pa.binary())])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def item_words(text: Column) -> Column:
    """An item's words, as the index has them."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _pieces(tests: DataFrame, width: int) -> DataFrame:
    """item and words; an item beyond ``PIECE_WORDS`` comes as pieces that share ``width - 1`` words."""
    words = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - width)
    at = F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS)))
    return words.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at") + 1, PIECE_WORDS + width - 1).alias("words"))


class _Slice:
    """Windows and rare terms of the items of one slice, as arrays over its vocabulary."""

    def __init__(self, rows: list, width: int) -> None:
        self.items = sorted({r["item"] for r in rows})
        number = {item: i for i, item in enumerate(self.items)}
        self.vocabulary = sorted({w for r in rows for w in r["words"]}, key=str.encode)
        code = {w: i for i, w in enumerate(self.vocabulary)}
        windows, owners = [], []
        self.pieces: list[tuple[int, np.ndarray]] = []
        for r in rows:
            words = np.array([code[w] for w in r["words"]], np.int32)
            piece = np.full((1, width), -1, np.int32)
            piece[0, : len(words)] = words[:width]
            if len(words) > width:
                piece = np.lib.stride_tricks.sliding_window_view(words, width)
            windows.append(piece)
            owners.append(np.full(len(piece), number[r["item"]], np.int32))
            self.pieces.append((number[r["item"]], np.unique(words)))
        self.windows = np.concatenate(windows)
        self.owners = np.concatenate(owners)

    def order(self, counts: np.ndarray, near_terms: int) -> None:
        """Put each window's offsets, and each piece's ``near_terms`` rarest terms, in order of ``counts``."""
        known = counts > 0
        here = np.where(self.windows >= 0, known[self.windows], True).all(axis=1)
        self.windows, self.owners = self.windows[here], self.owners[here]
        weight = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        self.offsets = np.argsort(weight, axis=1, kind="stable").astype(np.int32)
        near = [(i, t[np.lexsort((t, counts[t]))][:near_terms]) for i, t in ((i, t[known[t]]) for i, t in self.pieces) if len(t) >= near_terms]
        self.near = np.array([t for _, t in near], np.int32).reshape(len(near), near_terms)
        self.near_owners = np.array([i for i, _ in near], np.int32)
        self.pieces = []


class _Segment:
    """One segment's postings, ready to be intersected."""

    def __init__(self, row: dict, vocabulary: pa.Array) -> None:
        terms = cut(pa.array([row["terms"]], pa.utf8()), _SPACED).words
        self.local = pc.index_in(vocabulary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.postings = np.frombuffer(row["postings"], "<i4")
        self.bounds = np.concatenate([[0], np.cumsum([d["n_words"] for d in row["documents"]])]).astype(np.int64)
        self._keys: np.ndarray | None = None

    def keys(self) -> np.ndarray:
        """(term, position) of all postings as ascending integers."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) + self.postings
        return self._keys

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term.astype(np.int64) << 32) + position
        at = np.searchsorted(self.keys(), key)
        return (at < len(self.keys())) & (self.keys()[np.minimum(at, len(self.keys()) - 1)] == key)

    def occurrences(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``term``, and a position, for every posting of the given terms."""
        n = self.counts[term]
        which = np.repeat(np.arange(len(term)), n)
        before = np.repeat(np.cumsum(n) - n, n)
        return which, self.postings[np.repeat(self.first[term], n) + np.arange(len(which)) - before].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, "right") - 1


def _strips(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STARTS, "right")))
        yield begin, end
        begin = end


def _exact(segment: _Segment, part: _Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and last position + 1 of every window occurrence in a segment."""
    local = np.where(part.windows >= 0, segment.local[part.windows], 0) if len(part.windows) else part.windows
    alive = np.flatnonzero((local >= 0).all(axis=1))
    found = []
    rarest = part.offsets[alive, 0]
    for begin, end in _strips(segment.counts[local[alive, rarest]]):
        ids, off = alive[begin:end], rarest[begin:end]
        length = (part.windows[ids] >= 0).sum(axis=1)
        which, at = segment.occurrences(local[ids, off])
        start = at - off[which]
        bounds = segment.document(at)
        fits = (start >= segment.bounds[bounds]) & (start + length[which] <= segment.bounds[bounds + 1])
        which, start = which[fits], start[fits]
        for k in range(1, part.windows.shape[1]):
            off = part.offsets[ids[which], k]
            counts = off < length[which]
            good = ~counts | segment.holds(local[ids[which], off], start + off)
            which, start = which[good], start[good]
            if not len(which):
                break
        found.append((part.owners[ids[which]], start, start + length[which]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))  # type: ignore[return-value]


def _near(segment: _Segment, part: _Slice, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Item and document of every place where an item's rare terms lie within ``span`` words of the rarest."""
    local = segment.local[part.near] if len(part.near) else part.near
    alive = np.flatnonzero((local >= 0).all(axis=1))
    found = []
    for begin, end in _strips(segment.counts[local[alive, 0]] if len(alive) else np.empty(0, np.int64)):
        ids = alive[begin:end]
        which, at = segment.occurrences(local[ids, 0])
        document = segment.document(at)
        for k in range(1, local.shape[1]):
            low = np.maximum(at - span, segment.bounds[document])
            high = np.minimum(at + span, segment.bounds[document + 1] - 1)
            term = local[ids[which], k].astype(np.int64) << 32
            good = np.searchsorted(segment.keys(), term + low) < np.searchsorted(segment.keys(), term + high, "right")
            which, at, document = which[good], at[good], document[good]
            if not len(which):
                break
        found.append((part.near_owners[ids[which]], document))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(2))  # type: ignore[return-value]


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Sorted spans, those that meet made one."""
    out: list[dict[str, int]] = []
    for a, b in spans:
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


MATCH = "segment long, document int, spans array<struct<a:int,b:int>>, items array<string>, near array<string>"


def _match_rows(number: int, segment: _Segment, part: _Slice, span: int) -> list[dict]:
    owner, start, end = _exact(segment, part)
    near_owner, near_document = _near(segment, part, span)
    rows: dict[int, dict] = {}
    row = lambda d: rows.setdefault(d, {"segment": number, "document": d, "spans": [], "items": set(), "near": set()})
    document = segment.document(start)
    order = np.lexsort((start, document))
    for d, a, b, i in zip(document[order].tolist(), (start - segment.bounds[document])[order].tolist(), (end - segment.bounds[document])[order].tolist(), owner[order].tolist(), strict=True):
        row(d)["spans"].append((a, b))
        row(d)["items"].add(part.items[i])
    for d, i in zip(near_document.tolist(), near_owner.tolist(), strict=True):
        row(d)["near"].add(part.items[i])
    return [r | {"spans": _joined(r["spans"]), "items": sorted(r["items"]), "near": sorted(r["near"])} for r in rows.values()]


def _search_slice(index: DataFrame, rows: list, width: int, near_terms: int, span: int) -> DataFrame:
    context, part = index.sparkSession.sparkContext, _Slice(rows, width)
    sent = context.broadcast(part.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(sent.value, pa.utf8())
        for batch in batches:
            for row in batch.to_pylist():
                at = pc.index_in(vocabulary, value_set=cut(pa.array([row["terms"]], pa.utf8()), _SPACED).words).fill_null(-1).to_numpy(zero_copy_only=False)
                here = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(np.frombuffer(row["counts"], "<i4")[at[here]], pa.int64())], names=["term", "n"])

    counts = np.zeros(len(part.vocabulary), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    part.order(counts, near_terms)
    plan = context.broadcast(part)
    schema = pa.schema([
        ("segment", pa.int64()), ("document", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.utf8())), ("near", pa.list_(pa.utf8())),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = plan.value
        vocabulary = pa.array(part.vocabulary, pa.utf8())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if rows := _match_rows(row["segment"], _Segment(row, vocabulary), part, span):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return index.mapInArrow(find, MATCH)


def search(index: DataFrame, tests: DataFrame, width: int = WINDOW, near_terms: int = 4, near_span: int = 20) -> DataFrame:
    """Matches of the test items (item_id, text) by document: segment, document, spans, items, near.

    ``spans`` are the document's words (first, last + 1) inside any occurrence of
    ``width`` consecutive words of an item, joined where they meet; ``items`` the ids of
    items with such words. An item of fewer words, but not none, is one window. ``near``
    are the ids of items whose ``near_terms`` rarest distinct terms (of those that the
    documents hold; ties by term) all lie at most ``near_span`` words from one occurrence
    of the rarest; items with fewer such terms have no such match. Items with one id are
    one item; a null id is the empty string. Only documents with a match have a row.
    """
    pieces = materialize(_pieces(tests, width), "test-items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    slices = total // SLICE_WORDS + 1
    dealt = pieces.withColumn("_s", F.pmod(F.xxhash64("item", "words"), F.lit(slices)))
    matches: DataFrame | None = None
    for i in range(slices if total else 0):
        if rows := dealt.filter(F.col("_s") == i).select("item", "words").distinct().collect():
            found = _search_slice(index, rows, width, near_terms, near_span)
            matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        return index.sparkSession.createDataFrame([], MATCH)
    if slices == 1:
        return matches
    all_of = lambda c: F.flatten(F.collect_list(c))
    both = matches.groupBy("segment", "document").agg(F.array_sort(all_of("spans")).alias("spans"), all_of("items").alias("items"), all_of("near").alias("near"))
    start = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate("spans", start, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)["b"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(s))))
    return both.select("segment", "document", joined.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near"))


def decontaminate(docs: DataFrame, tests: DataFrame, path: str, width: int = WINDOW, near_terms: int = 4, near_span: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items
    with occurring windows, whose sorted and comma-joined ids ``items_sha256`` digests;
    ``n_near`` counts items by proximity. The index stays at ``path``. Null and empty
    texts have no words; rows that repeat come back as often; a null doc_id stays null.
    An empty table of documents gives no row, an empty table of items no hits. Other
    columns are not read.
    """
    index = write_index(docs, path)
    found = materialize(search(index, tests, width, near_terms, near_span), "matches")
    hits = found.select(
        "segment", "document",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("ids"), F.size("near").cast("long").alias("n_near"),
    )
    rows = index.select("segment", F.posexplode("documents").alias("document", "d")).select("segment", "document", "d.doc_id", F.col("d.n_words").cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(hits, ["segment", "document"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
    )
