"""Token-ID output: documents as token ids in files of Simple-8b words, and the way back.

A token file set is a folder of Parquet files, so that Spark alone moves the bytes to and from whatever store holds
them. Each row is a segment: consecutive documents in ascending ``doc_id`` order, with

- ``shard``, ``segment``: place of the segment (shards are in ascending order of ``doc_id``),
- ``first_token``: ids of the shard before the segment,
- ``doc_ids``, ``lengths``: the documents and the number of ids of each,
- ``offsets``: words before each block of 128 ids, ``words``: the Simple-8b words, little-endian.

Cases: a null text has no ids of its own (only the end id), as has an empty one; null ids come first; rows that share a
``doc_id`` stay separate documents, ordered by their text; an empty table gives an empty file set. A segment holds a
bounded number of bytes of text, or a single document.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import simple8b
from factloom.llm.common import encode_words, ragged, text_chunks

SEGMENT = "shard int, segment int, first_token long, doc_ids array<bigint>, lengths array<int>, offsets array<int>, words binary"
#: Distinct runs of letters in each of the two generations whose ids a worker keeps, and runs given to the library in one text.
CACHE, JOINED = 400_000, 500
#: What stands behind a word as a unit of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of precomposed Latin letters; but for U+0130, whose lower case is two characters.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
LETTERS_AHEAD = LETTERS[:-1]


class WordTokenizer:
    """Encodes texts word by word with a tokenizers file whose tokens don't reach across white space.

    A text's ids are its words' ids in turn. A word of Latin letters and the punctuation behind it are separate units
    to such a tokenizer, which lowers letters; so a worker encodes each lower-cased run of letters once, many in one
    call: a token that ends in the word-end mark ends a run. Any other word is encoded as it stands. With a file of whose
    tokens this doesn't hold, by a probe, whole texts are encoded as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.by_word = True
        probe = ["Ab, cd  ef\tGH!? x2y ...no\n\u00c9t\u00e9 ab-cd (ef) it's 'tis \u4f60\u597d 12.5 z", "a b c", " lead trail "]
        got = self([t.encode() for t in probe], 0)[0].tolist()
        self.by_word = got == [k for t in probe for k in [*self.library.encode(t, add_special_tokens=False).ids, 0]]

    def units(self, runs: list[bytes], others: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each unit as 32-bit integers; those seen not long ago are kept, in two generations."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, {}
        unknown = []
        for u in runs:
            got = new.get(u)
            if got is None:
                got = old.get(u)
                if got is None:
                    unknown.append(u)
                    continue
                new[u] = got
            out[u] = got
        joined = [b" ".join(unknown[k : k + JOINED]).decode() for k in range(0, len(unknown), JOINED)]
        ids = np.array([k for e in self.library.encode_batch_fast(joined, add_special_tokens=False) for k in e.ids], np.uint32)
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist() if len(ids) else []
        a = 0
        for u, b in zip(unknown, ends, strict=True):
            out[u] = new[u] = raw[a:b]
            a = b
        for u, e in zip(others, self.library.encode_batch_fast([u.decode() for u in others], add_special_tokens=False), strict=True):
            out[u] = np.array(e.ids, np.uint32).tobytes()
        return out

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text); each text ends with ``end_id``."""
        if not self.by_word:
            each = [np.array([*e.ids, end_id], np.uint32) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        words, index, counts = encode_words(texts)
        whole = pa.array(words, pa.binary()).cast(pa.string())
        run = pc.utf8_rtrim(whole, PUNCTUATION)
        is_run = pc.match_substring_regex(run, LETTERS)
        unit = pc.if_else(is_run, pc.utf8_lower(run), whole).dictionary_encode()
        tail = pc.if_else(is_run, pc.utf8_slice_codeunits(pc.replace_substring_regex(whole, LETTERS_AHEAD, " "), 1), "").dictionary_encode()
        of_run = np.zeros(len(unit.dictionary), bool)
        of_run[unit.indices.to_numpy()[is_run.to_numpy(zero_copy_only=False)]] = True
        names, tails = unit.dictionary.cast(pa.binary()).to_pylist(), tail.dictionary.cast(pa.binary()).to_pylist()
        ids_of = self.units([u for u, r in zip(names, of_run, strict=True) if r], list({u for u, r in zip(names, of_run, strict=True) if not r} | set(tails)))
        both = [ids_of[u] for u in names] + [ids_of[t] for t in tails]
        lengths = np.array([len(p) // 4 for p in both], np.int64)
        pairs = np.stack([unit.indices.to_numpy(), tail.indices.to_numpy() + len(names)], axis=1).ravel()
        flat, got = ragged(np.frombuffer(b"".join(both), np.uint32), lengths, pairs)
        flat, lengths = np.append(flat, np.uint32(end_id)), np.append(got.reshape(-1, 2).sum(axis=1), 1)
        # the end id stands as one more word behind each text's words
        index = np.insert(index.astype(np.int64), np.cumsum(counts), len(words))
        ids, got = ragged(flat, lengths, index)
        ends = np.cumsum(counts + 1)
        total = np.concatenate([[0], np.cumsum(got)])
        return ids, np.diff(np.concatenate([[0], total[ends]]))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) to a token file set at ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, done = WordTokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for k, (ids, texts) in enumerate(text_chunks(batches)):
            tokens, lengths = tokenizer(texts, end_id)
            words, offsets = simple8b.encode(tokens)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([k], pa.int32()), "first_token": pa.array([done], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32())), "offsets": pa.array([offsets], pa.list_(pa.int32())), "words": pa.array([words.tobytes()], pa.binary())}
            )
            done += len(tokens)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")  # very many rows may share an id, or have none
    ordered.mapInArrow(encode, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file set: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (array of long)."""
    return _read(spark, path, "ids array<bigint>", lambda ids: ids.astype(np.int64))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with ``ids_crc32`` (of the ids as little-endian 32-bit integers) instead of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    segments = spark.read.schema(SEGMENT).parquet(path)
    # one row per shard, so as many as partitions wrote the files, whatever the number of documents
    sizes = segments.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r.shard] = total
        total += r.n
    name, kind = column.split(" ", 1)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ids = simple8b.decode(np.frombuffer(r["words"], "<u8"), np.array(r["offsets"], np.int64), int(lengths.sum()))
                ends = np.cumsum(lengths)
                first = starts[r["shard"]] + r["first_token"] + ends - lengths
                values = [value(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(first, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), name: pa.array(values, pa.list_(pa.int64()) if "array" in kind else pa.int64())})

    return segments.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")
