"""Substring dedup: words that repeat a passage of an earlier document go.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window over it has the word sequence of a
window of a document of smaller id. Any such window holds, where the earlier document has it, one of that document's
non-overlapping blocks of ``BLOCK = (WINDOW + 1) / 2`` words whole. So:

1. every document's blocks are indexed, and every document's rolling windows of ``BLOCK`` words probe them: an exchange
   of hashes tells each batch which of its block-sized windows are an indexed block that more than one document holds;
2. around these anchors, windows of ``WINDOW`` words are looked up by a second exchange, which tells for each whether a
   document of smaller id has it: neighbouring ones join to the maximal repeats;
3. the words under them go.

A window is identified by 64 bits of hash and the bucket's bits beyond; anchors only by about 40 bits, as what they let
through by chance is rejected in the second step. A step's work and data are in proportion to the words, however often
a passage repeats.

Cases: a null text has no words; a text shorter than a window stays; whole texts are read; passages within one document,
or shared by rows of one id, don't count. A null id counts as the smallest. Each row gives one row. Empty tables are fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.batches import ANSWER, SENT, Words, answered, bits, buckets_for, by_row, rows_by_bucket, split, with_answers, word_batches
from factloom.llm.common import materialised, rolling

WINDOW = 13
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _inside(words: Words, width: int) -> np.ndarray:
    """Positions where a window of ``width`` words of one document begins."""
    n = len(words.doc) - width + 1
    return np.flatnonzero(words.doc[:n] == words.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


class Anchors:
    """A batch's block-sized windows: what it sends to the first exchange, and the places that the answer points to."""

    def __init__(self, words: Words, block: int, buckets: int):
        self.at = _inside(words, block)
        h = rolling(words.hashes(1), block, 11)[self.at]
        bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        keys = bucket << np.uint64(32) | h >> np.uint64(32)
        self.order = np.argsort(keys)
        k = keys[self.order]
        new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.values = (k[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.bucket = (k[self.starts] >> np.uint64(32)).astype(np.int64)

    def flags(self, words: Words, block: int) -> np.ndarray:
        """By distinct window: 1 if it is an indexed block, 2 more if several documents of the batch hold it."""
        rank, _ = words.ranks()
        at = self.at[self.order]
        begin = words.ends[words.doc[at]] - words.counts[words.doc[at]]
        indexed = (at - begin) % block == 0
        if not len(at):
            return np.zeros(0, np.uint8)
        owner = rank[words.doc[at]]
        several = np.maximum.reduceat(owner, self.starts) != np.minimum.reduceat(owner, self.starts)
        return np.bitwise_or.reduceat(indexed, self.starts).astype(np.uint8) + 2 * several.astype(np.uint8)


class Windows:
    """A batch's windows around anchors."""

    def __init__(self, words: Words, row: dict, window: int, block: int, buckets: int):
        anchors = Anchors(words, block, buckets)
        hot = np.zeros(len(words.doc) + 1, np.int32)
        hot[1:][anchors.at[anchors.order][answered(row, 0, anchors.bucket)[anchors.group]]] = 1
        hot = np.cumsum(hot)  # anchors before each position
        at = _inside(words, window)
        self.at = at[hot[at + window - block + 1] > hot[at]]
        keys = rolling(words.hashes(2), window, 12)[self.at]
        self.order, bucket, new = split(keys, buckets)
        self.starts = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.bucket = bucket[self.starts]
        self.values = keys[self.order][self.starts]
        rank, self.ids = words.ranks()
        self.owner = rank[words.doc[self.at[self.order]]]
        self.first = np.minimum.reduceat(self.owner, self.starts) if len(self.at) else np.zeros(0, np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """A row ``RESULT`` for each document, and ``kept_text`` if asked for."""
    block = (window + 1) // 2
    batches = word_batches(docs)
    buckets = buckets_for(batches)

    def probe(row: dict) -> pa.RecordBatch:
        words = Words(row)
        a = Anchors(words, block, buckets)
        f = a.flags(words, block)
        return rows_by_bucket(words.batch, a.bucket, lambda i, j: a.values[i:j].tobytes() + f[i:j].tobytes())

    def anchor(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        raw = [x.as_py() for x in table["payload"]]
        values = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(raw, n, strict=True)])
        flags = np.concatenate([np.frombuffer(x, np.uint8, k, 4 * k) for x, k in zip(raw, n, strict=True)])
        order = np.argsort(values)
        v, f = values[order], flags[order]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        sizes = np.diff(np.append(starts, len(v)))
        seen = np.bitwise_or.reduceat(f, starts)
        hot = np.zeros(len(v), bool)
        hot[order] = np.repeat((seen & 1 > 0) & ((sizes > 1) | (seen & 2 > 0)), sizes)
        return _answers(table, n, hot)

    def look(row: dict) -> pa.RecordBatch | None:
        words = Words(row)
        w = Windows(words, row, window, block, buckets)
        if len(w.at):
            first = w.ids[w.first]
            base = first.min()
            wide = int(first.max()) - int(base) >= 1 << 32
            own = first if wide else (first - base).astype(np.uint32)
            head = np.array([wide, base], np.int64).tobytes()
            return rows_by_bucket(words.batch, w.bucket, lambda i, j: head + w.values[i:j].tobytes() + own[i:j].tobytes())
        return None

    def earlier(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        values, first = [], []
        for x, k in zip(table["payload"], n, strict=True):
            raw = x.as_py()
            wide, base = np.frombuffer(raw, np.int64, 2)
            values.append(np.frombuffer(raw, np.uint64, k, 16))
            first.append(np.frombuffer(raw, np.int64 if wide else np.uint32, k, 16 + 8 * k).astype(np.int64) + (0 if wide else base))
        values, first = np.concatenate(values), np.concatenate(first)
        order = np.argsort(values)
        v = values[order]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        least = np.minimum.reduceat(first[order], starts)
        answer = np.zeros(len(v), bool)
        answer[order] = first[order] > np.repeat(least, np.diff(np.append(starts, len(v))))
        return _answers(table, n, answer)

    def finish(row: dict) -> pa.RecordBatch:
        words = Words(row)
        w = Windows(words, row, window, block, buckets)
        gone = answered(row, 1, w.bucket)[w.group] | (w.owner > w.first[w.group]) if len(w.at) else np.zeros(0, bool)
        edge = np.zeros(len(words.doc) + 1, np.int32)
        at = w.at[w.order][gone]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        kept = np.cumsum(edge[:-1]) == 0
        flat, got = words.pieces(np.flatnonzero(kept))
        ends = np.concatenate([[0], np.cumsum(got)])[np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], words.ends])]]
        raw = flat.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        left = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], words.ends])])
        out = {"doc_id": pa.array(words.doc_ids, pa.int64()), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(words.counts - left, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
        if with_text:
            out["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.RecordBatch.from_pydict(out)

    first = materialised(batches.mapInArrow(by_row(probe), SENT).groupBy("bucket").applyInArrow(anchor, ANSWER))
    second = materialised(with_answers(batches, first).mapInArrow(by_row(look), SENT).groupBy("bucket").applyInArrow(earlier, ANSWER))
    return with_answers(batches, first, second).mapInArrow(by_row(finish), RESULT + (", kept_text string" if with_text else ""))


def _answers(table: pa.Table, n: np.ndarray, yes: np.ndarray) -> pa.Table:
    """Rows ``ANSWER`` for the batches with a yes."""
    ends = np.cumsum(n)
    own = [yes[e - k : e] for e, k in zip(ends, n, strict=True)]
    some = np.array([k for k, x in enumerate(own) if x.any()], np.int64)
    return pa.table({"bucket": table["bucket"].take(some), "batch": table["batch"].take(some), "answer": pa.array([bits(own[k]) for k in some], pa.binary())})
