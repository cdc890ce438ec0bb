"""Texts as batches of word numbers, and exchanges of packed hashes between batches.

A batch holds some documents of one input partition as one row: their ids, the number of words of each, the distinct
words, and the words as numbers of those. Batches are written once, so every later step sees the same ones.

An *exchange* answers a question about hashes that occur in many batches. Each batch sends its distinct hashes, sorted,
to buckets chosen by some of their bits, packed in one row per bucket; a bucket answers each batch with one value per
hash, in the same order. No hash is sent twice by a batch, so a bucket's rows don't depend on how often a hash occurs,
and a third of all words being the same makes no bucket larger than the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import encode_words, materialised, mix, n_partitions, ragged, text_chunks

#: Bytes of text in a batch.
CHUNK = 2_000_000
#: Hashes in a bucket of an exchange, 32 MB as they are unpacked.
BUCKET = 4_000_000
BATCH = "batch long, doc_ids array<bigint>, counts array<int>, vocabulary binary, vocabulary_lengths binary, words binary"
SENT = "bucket int, batch long, n int, payload binary"
ANSWER = "bucket int, batch long, answer binary"


def pack(x: np.ndarray) -> bytes:
    """An array of unsigned integers: planes of its bytes, compressed."""
    x = np.ascontiguousarray(x)
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_batches(docs: DataFrame) -> DataFrame:
    """The documents' batches, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(text_chunks(batches, CHUNK)):
            vocabulary, numbers, counts = encode_words(texts)
            often = np.argsort(-np.bincount(numbers, minlength=len(vocabulary)), kind="stable")  # small numbers pack better
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            vocabulary, numbers = [vocabulary[k] for k in often.tolist()], place[numbers] if len(numbers) else numbers
            row = {"batch": [first + k], "doc_ids": [ids], "counts": [counts], "vocabulary": [zlib.compress(b"".join(vocabulary), 1)], "vocabulary_lengths": [pack(np.array([len(w) for w in vocabulary], np.uint32))], "words": [pack(numbers.astype(np.uint32))]}
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    return materialised(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BATCH))


def buckets_for(batches: DataFrame) -> int:
    """Buckets of an exchange such that one holds about ``BUCKET`` hashes at most, if each word has one."""
    words = batches.agg(F.sum(F.expr("aggregate(counts, 0L, (n, x) -> n + x)"))).first()[0] or 0
    return max(n_partitions(batches.sparkSession), -(-words // BUCKET))


def by_row(run: Callable[[dict], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: what ``run`` makes of each row. One row is unpacked at a time, and what it took is freed before the next."""

    def each(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for k in range(table.num_rows):
                if (out := run(table.slice(k, 1).to_pylist()[0])) is not None:
                    yield out
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for other tasks

    return each


class Words:
    """A batch, unpacked."""

    def __init__(self, row: dict):
        self.batch, self.counts = row["batch"], np.array(row["counts"], np.int64)
        self.doc_ids = row["doc_ids"]
        self.numbers = unpack(row["words"], np.uint32).astype(np.int64)
        self.lengths = unpack(row["vocabulary_lengths"], np.uint32).astype(np.int64)
        self.bytes = np.frombuffer(zlib.decompress(row["vocabulary"]), np.uint8)
        self.ends = np.cumsum(self.counts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int) -> np.ndarray:
        """A hash of each word of the texts."""
        b = self.bytes.astype(np.uint64)
        starts = np.cumsum(self.lengths) - self.lengths
        place = (np.arange(len(b)) - np.repeat(starts, self.lengths)).astype(np.uint64)
        if not len(b):
            return np.zeros(0, np.uint64)
        own = mix((b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + mix(place * np.uint64(256) + np.uint64(seed)))
        return mix(np.add.reduceat(own, starts))[self.numbers]

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(for each document its rank by id, ids in that order); a null id comes first."""
        ids = np.array([-(2**63) if d is None else d for d in self.doc_ids], np.int64)
        ordered, rank = np.unique(ids, return_inverse=True)
        return rank, ordered

    def pieces(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the picked words one after another, each with a space behind it, their lengths with that)."""
        starts = np.cumsum(self.lengths) - self.lengths
        spaced = np.full(len(self.bytes) + len(self.lengths), 32, np.uint8)
        spaced[np.arange(len(self.bytes)) + np.repeat(np.arange(len(self.lengths)), self.lengths)] = self.bytes
        assert len(starts) == len(self.lengths)
        return ragged(spaced, self.lengths + 1, self.numbers[pick])


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys by bucket and key, their buckets in that order, whether a key differs from the one before)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket)) if buckets > 1 else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    return order, bucket[order], new


def rows_by_bucket(batch: int, bucket: np.ndarray, payload: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """A row for each bucket of the sorted ``bucket``, of ``payload(from, to)``."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
    spans = list(zip(cuts, cuts[1:], strict=False))
    return pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), "batch": pa.array([batch] * len(spans), pa.int64()), "n": pa.array([b - a for a, b in spans], pa.int32()), "payload": pa.array([payload(a, b) for a, b in spans], pa.binary())})


def with_answers(batches: DataFrame, *answers: DataFrame) -> DataFrame:
    """``batches`` with ``answers``: an array of (kind, bucket, answer), kind counting the frames given; null if none."""
    both = None
    for kind, a in enumerate(answers):
        a = a.select("batch", F.struct(F.lit(kind).alias("kind"), "bucket", "answer").alias("a"))
        both = a if both is None else both.unionByName(a)
    return batches.join(both.groupBy("batch").agg(F.collect_list("a").alias("answers")), "batch", "left")


def answered(row: dict, kind: int, bucket: np.ndarray, kindof=None) -> np.ndarray:
    """The answers to a batch's distinct keys, given their sorted ``bucket``: bits, or integers; 0 where none came."""
    out = np.zeros(len(bucket), bool if kindof is None else kindof)
    for a in row["answers"] or ():
        if a["kind"] == kind:
            lo, hi = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(zlib.decompress(a["answer"]), np.uint8), count=hi - lo) if kindof is None else unpack(a["answer"], kindof)
    return out


def bits(x: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(x).tobytes(), 1)
