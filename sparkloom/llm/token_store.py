"""Token ids as binary blocks, each document its own zstandard frame.

A store is a folder with two Parquet tables. ``dictionary`` has one row: the shared
dictionary, trained on serialized id arrays, and its SHA-256. ``blocks`` has one row
per block of consecutive documents in ascending key order: the dictionary's hash, the
keys, an offset index (one more offset than documents), and the frames end to end. A
short document is read by its two offsets alone. Blocks are written by Spark's own
writer, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, range_splits, shuffle_partitions
from sparkloom.llm.tokens import word_level

#: Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 8_000_000, 65_536
#: Serialized ids in a block, before compression. One longer document is one block.
BLOCK_BYTES = 4_000_000
LEVEL = 3

_ROWS = "bucket int, doc_id long, ids binary"
_BLOCKS = "bucket int, block int, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, data binary"


def encode(docs: DataFrame, vocabulary: str, end_id: int = 2, splits: list[int] | None = None) -> DataFrame:
    """bucket, doc_id and the ids as little-endian unsigned 16-bit integers.

    Null and empty texts hold the end id only. ``splits`` cut the keys into buckets in
    ascending order; null keys come first.
    """
    cuts = splits or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, end = word_level(vocabulary).encode, end_id.to_bytes(2, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            buckets = [0 if k is None else bisect_left(cuts, k) for k in keys]
            ids = [one(t.as_py()) + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _ROWS)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = 2) -> bytes:
    """A zstandard dictionary from a bounded sample of whole documents.

    The sample is the documents whose keys hash lowest. Too few or too alike samples
    to train on give a dictionary of their raw bytes, an empty table an empty one.
    """
    import zstandard

    lowest = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    keys = [r["doc_id"] for r in lowest.collect() if r["doc_id"] is not None]
    ids = encode(docs.filter(F.col("doc_id").isin(keys)), vocabulary, end_id).filter(F.length("ids") < SAMPLE_BYTES // 100).limit(SAMPLE_DOCUMENTS)
    samples, total = [], 0
    for row in sorted(ids.collect(), key=lambda r: (r["doc_id"], bytes(r["ids"]))):
        if total + len(row["ids"]) <= SAMPLE_BYTES:
            samples.append(bytes(row["ids"]))
            total += len(row["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b"".join(samples)[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> str:
    """Encode and write all documents; returns the dictionary's SHA-256.

    Keys are dealt into buckets by value, so a task sorts and writes a range of keys
    and no task sees all. Rows with equal keys are ordered by their ids.
    """
    import zstandard

    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    data = train_dictionary(docs, vocabulary, end_id)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Frames leave out what the index and the vocabulary already tell.
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_dict_id=False, write_content_size=True)
        pack = zstandard.ZstdCompressor(dict_data=_dictionary(data), compression_params=params).compress
        bucket, number, keys, offsets, frames, raw = None, 0, [], [0], [], 0

        def row() -> pa.RecordBatch:
            values = [[bucket], [number], [sha], [keys], [offsets], [b"".join(frames)]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["bucket", "block", "dictionary_sha256", "doc_ids", "offsets", "data"])

        for batch in batches:
            for b, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = ids.as_py()
                if keys and (b != bucket or raw + len(ids) > BLOCK_BYTES):
                    yield row()
                    number = number + 1 if b == bucket else 0
                    keys, offsets, frames, raw = [], [0], [], 0
                elif not keys:
                    number = 0
                bucket = b
                frame = pack(ids)
                keys.append(key)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                raw += len(ids)
        if keys:
            yield row()

    rows = encode(docs, vocabulary, end_id, range_splits(docs, "doc_id", n))
    rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids").mapInArrow(blocks, _BLOCKS).write.parquet(f"{path}/blocks")
    return sha


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {path} is damaged")
    return row["sha256"], data


def read_store(spark: SparkSession, path: str, keys: list[int] | None = None, keep_ids: bool = False) -> DataFrame:
    """Every stored document: bucket, block, position, doc_id, n_tokens, ids_crc32 (and ids).

    ``keys`` (a short list) reads those documents only, each by its offsets. The CRC is
    over the ids as little-endian unsigned 32-bit integers.
    """
    import zstandard

    sha, data = load_dictionary(spark, path)
    wanted = None if keys is None else frozenset(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress
        for batch in batches:
            for bucket, block, used, doc_ids, offsets, frames in zip(*(batch.column(i) for i in range(6)), strict=True):
                if used.as_py() != sha:
                    raise ValueError(f"block {block} of bucket {bucket} was written with another dictionary")
                at, body, out = offsets.values.to_pylist(), frames.as_buffer(), ([], [], [], [], [])
                view = memoryview(body)
                for i, key in enumerate(doc_ids.values.to_pylist()):
                    if wanted is None or key in wanted:
                        ids = np.frombuffer(unpack(view[at[i] : at[i + 1]]), "<u2").astype("<u4")
                        for values, value in zip(out, (i, key, len(ids), zlib.crc32(ids), ids.tobytes() if keep_ids else None), strict=True):
                            values.append(value)
                n = len(out[0])
                columns = [pa.array([bucket.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:4]]]
                names = ["bucket", "block", "position", "doc_id", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if keys is not None:
        rows = rows.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(k) for k in keys]).cast("array<long>")))
    schema = "bucket int, block int, position int, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return rows.mapInArrow(work, schema)


def with_starts(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Sums run within a bucket; of the buckets, as many as tasks, only totals meet.
    """
    kept = materialize(stored.select("bucket", "block", "position", "doc_id", "n_tokens", "ids_crc32"), "stored")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("bucket").agg(F.sum("n_tokens").alias("_t"))
    bases = totals.select("bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("bucket").orderBy("block", "position").rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.withColumn("_w", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(bases, "bucket")
        .select("doc_id", (F.col("_base") + F.col("_w")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
