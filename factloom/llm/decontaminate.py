"""Benchmark decontamination: approximate occurrences of test items in documents, by pigeonhole edit matching.

Texts are compared in a normal form: lower case, runs of anything but letters and digits as one space, UTF-8. An item of
n bytes may be changed by up to ``budget(n)`` byte insertions, deletions and substitutions. It is split into one piece
more than that, so any occurrence within the budget holds some piece unchanged. A scan of the document finds exact
piece hits: the bytes at each position, hashed two overlapping words at a time, are looked up in a bitmap of all pieces'
beginnings, and what passes is compared in full. Around each hit, Myers' bit-parallel distance verifies the item.

The items are sent to the workers in parts of ``PART`` bytes at most; each part is one scan of the documents.

Cases: a null or empty text, or item, matches nothing; an item with a null id counts as any other, and its rows in
``matches`` have a null ``item_id``; items under ``SHORTEST`` normal bytes are looked for unchanged,
as whole words. Of items that repeat, each reports its hits. Rows that repeat a document repeat its hits. Texts are
scanned whole. The occurrence reported is the one of least distance, the first of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, map_batches

#: Bytes of a piece that are hashed (two words of eight, one shared byte), so also the least length of a piece.
HEAD = 15
SHORTEST = HEAD
PART = 4_000_000
BITS = 22
_OTHER = re.compile(r"[\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
HITS = "doc_id long, item_id long, distance int, start int, length int"


def normal(text: str | None) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode() if text else b""


_TO_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal_many(texts: list[bytes]) -> list[bytes]:
    """``normal`` of UTF-8 texts; ASCII ones without a regular expression."""
    return [b" ".join(t.lower().translate(_TO_SPACE).split()) if t.isascii() else normal(t.decode()) for t in texts]


def budget(n: int) -> int:
    """Edits allowed in an item of ``n`` bytes: such that each piece has ``HEAD`` bytes at least."""
    return max(0, n // HEAD - 1)


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(offset, piece): ``budget + 1`` pieces of about equal length."""
    k = budget(len(item)) + 1
    cuts = [len(item) * j // k for j in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: bytes, window: bytes) -> tuple[int, int]:
    """(least edit distance of ``item`` to a substring of ``window``, end of the first such substring)."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds items, given as (item_id, normal bytes), in normal texts."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for k, (_, x) in enumerate(items):
            if 0 < len(x) < SHORTEST:
                self.short[x].append(k)
        self.words = ahocorasick.Automaton()
        for x in self.short:
            self.words.add_word(f" {x.decode('latin-1')} ", x)  # a character a byte
        if self.short:
            self.words.make_automaton()
        self.heads: dict[bytes, list[tuple[int, int, bytes]]] = defaultdict(list)
        for k, (_, x) in enumerate(items):
            if len(x) >= SHORTEST:
                for offset, p in pieces(x):
                    self.heads[p[:HEAD]].append((k, offset, p))
        self.bitmap = np.zeros(1 << BITS, bool)
        if self.heads:
            raw = np.frombuffer(b"".join(self.heads), np.uint8).reshape(-1, HEAD)
            a, b = np.ascontiguousarray(raw[:, :8]).view("<u8").ravel(), np.ascontiguousarray(raw[:, 7:]).view("<u8").ravel()
            self.bitmap[self._slot(a, b)] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * _M1 ^ b * _M2) * _M1 >> np.uint64(64 - BITS)).astype(np.int64)

    def candidates(self, text: bytes) -> np.ndarray:
        """Positions whose ``HEAD`` bytes may begin a piece."""
        found = []
        for o in range(8):
            n = (len(text) - o - HEAD) // 8 + 1
            if n > 0:
                a = np.frombuffer(text, "<u8", n, o)
                b = np.frombuffer(text, "<u8", n, o + 7)
                found.append(np.flatnonzero(self.bitmap[self._slot(a, b)]) * 8 + o)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, length) of the best occurrence of each item within its budget in each text."""
        joined = b"\0".join(texts)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        at = self.candidates(joined)
        for p, k in zip(at.tolist(), (np.searchsorted(starts, at, side="right") - 1).tolist(), strict=True):
            for item, offset, piece in self.heads.get(joined[p : p + HEAD], ()):
                if not joined.startswith(piece, p):
                    continue
                x = self.items[item][1]
                spare = budget(len(x))
                first = p - offset
                if (k, item, first) in seen:
                    continue
                seen.add((k, item, first))
                lo, hi = max(int(starts[k]), first - spare), min(int(starts[k + 1]) - 1, first + len(x) + spare)
                window = joined[lo:hi]
                if joined.startswith(x, first) and first >= lo:
                    distance, begin, length = 0, first - int(starts[k]), len(x)
                else:
                    distance, end = myers(x, window)
                    if distance > spare:
                        continue
                    _, back = myers(x[::-1], window[:end][::-1])
                    begin, length = lo + end - back - int(starts[k]), back
                if (k, item) not in best or (distance, begin) < best[k, item][:2]:
                    best[k, item] = (distance, begin, length)
        if self.short:
            for k, t in enumerate(texts):
                for end, x in self.words.iter(f" {t.decode('latin-1')} "):
                    for item in self.short[x]:
                        best.setdefault((k, item), (0, end - len(x) - 1, len(x)))  # places come in order
        return [(k, item, *v) for (k, item), v in best.items()]


def parts(items: Iterator[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    out: list[list[tuple[int, bytes]]] = []
    size = PART
    for i, x in items:
        if size + len(x) > PART:
            out.append([])
            size = 0
        out[-1].append((i, x))
        size += len(x)
    return out


def _sent(docs: DataFrame, benchmark: DataFrame) -> list:
    """The items with a text, normal, as broadcasts of bounded size."""
    source = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = ((r.item_id, normal(r.text)) for r in source.toLocalIterator())
    return [docs.sparkSession.sparkContext.broadcast(p) for p in parts((i, x) for i, x in rows if x)]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no occurrence of an item."""
    for sent in _sent(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                for places, part in chunks(range(len(texts)), texts):
                    for k, *_ in matcher.search(normal_many(part)):
                        keep[places[k]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item of which it holds an occurrence: ``HITS``; places are in the normal form."""
    spark = docs.sparkSession
    found = None
    for sent in _sent(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                for ids, texts in chunks(batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                    got = matcher.search(normal_many(texts))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[g[0]] for g in got], pa.int64()), "item_id": pa.array([matcher.items[g[1]][0] for g in got], pa.int64()), "distance": pa.array([g[2] for g in got], pa.int32()), "start": pa.array([g[3] for g in got], pa.int32()), "length": pa.array([g[4] for g in got], pa.int32())})

        hits = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], HITS) if found is None else found
