"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces and one Viterbi pass.

The automaton reads a text once. At each position it follows the output links of its state, that is, visits each piece
that ends there, longest first, and relaxes the best score of the text up to it. A character that no piece covers costs
``UNKNOWN_PENALTY`` more than the worst piece and becomes its UTF-8 bytes' pieces. Of equal scores, the longer last
piece wins. As in the library, a text gets a space before it and a space is written ``▁``; unlike there, a ``▁`` of the
text itself becomes byte pieces, so that decoding gives back every text exactly.

No piece holds ``▁`` behind another character (checked when a model is loaded), so no best path crosses the start of a
run of spaces, or a line feed that no piece holds: each stretch between such places is segmented by itself, and a
worker keeps the segmentations of short stretches that it has seen.

Cases: a null text is encoded like an empty one, to no ids, and decodes to the empty text; ids that are null decode to
the empty text; an id outside the vocabulary decodes to U+FFFD, and one to three bytes at the end, no whole id, to nothing. A column of the output's name that the input has already is replaced; all other columns are kept.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import map_batches, ragged

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches that a worker keeps until its task ends, and the longest of them in characters.
CACHE, CACHED_LENGTH = 200_000, 64
#: Transitions of the automaton that a worker adds to it, so that failure links need not be followed again.
LEARNT = 200_000
#: Bytes of text that are unpacked at once.
STEP = 4_000_000


class Automaton:
    """Goto, failure and output links over a set of strings."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.own: list[tuple[int, int, float] | None] = [None]
        for text, number, score in pieces:
            s = 0
            for c in text:
                t = self.next[s].get(c)
                if t is None:
                    t = self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.own.append(None)
                s = t
            self.own[s] = (len(text), number, score)
        n = len(self.next)
        self.fail, self.output = [0] * n, [0] * n
        queue = deque(self.next[0].values())
        while queue:
            s = queue.popleft()
            f = self.fail[s]
            self.output[s] = f if self.own[f] else self.output[f]
            for c, t in self.next[s].items():
                g = f
                while g and c not in self.next[g]:
                    g = self.fail[g]
                self.fail[t] = self.next[g].get(c, 0) if s else 0
                queue.append(t)


class Model:
    """A SentencePiece model's pieces, and encoding and decoding with them."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        text = [library.id_to_piece(k) for k in range(n)]
        ordinary = [k for k in range(n) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k) or library.is_unused(k))]
        self.bytes = {int(text[k][3:5], 16): k for k in range(n) if library.is_byte(k)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no piece for some byte")
        if any(SPACE in text[k].lstrip(SPACE) or "\n" in text[k] for k in ordinary):
            raise ValueError("a piece reaches across the start of a word or a line")
        scores = [library.get_score(k) for k in ordinary]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.automaton = Automaton([(text[k], k, s) for k, s in zip(ordinary, scores, strict=True)])
        out = [b""] * n
        for k in ordinary:
            out[k] = text[k].replace(SPACE, " ").encode()
        for b, k in self.bytes.items():
            out[k] = bytes([b])
        out.append("\ufffd".encode())
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.piece_lengths = np.array([len(x) for x in out], np.int64)
        self.cache: dict[str, bytes] = {}
        self.learnt = 0

    def segment(self, text: str) -> list[int]:
        """Ids of ``text`` (with ``▁`` for spaces) of the greatest total score."""
        a = self.automaton
        nexts, own, output, fail, unknown = a.next, a.own, a.output, a.fail, self.unknown
        best = [0.0]
        back: list[tuple[int, int]] = [(0, 0)]
        s = 0
        for i, c in enumerate(text, 1):
            t = nexts[s].get(c)
            if t is None:
                f = s
                while f and c not in nexts[f]:
                    f = fail[f]
                t = nexts[f].get(c, 0)
                if self.learnt < LEARNT:  # the next time without failure links
                    nexts[s][c] = t
                    self.learnt += 1
            s = t
            most, step = best[i - 1] + unknown, (1, -1)
            o = s if own[s] else output[s]
            longest = 0
            while o:
                length, number, score = own[o]
                score += best[i - length]
                if score > most or (score == most and length > longest):
                    most, step, longest = score, (length, number), length
                o = output[o]
            best.append(most)
            back.append(step)
        i, out = len(text), []
        while i:
            length, number = back[i]
            if number < 0:
                out += [self.bytes[b] for b in reversed(text[i - 1].encode())]
            else:
                out.append(number)
            i -= length
        return out[::-1]

    def stretch(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            ids = [self.bytes[b] for b in text.encode()] if text == SPACE else self.segment(text.replace(" ", SPACE))
            got = np.array(ids, np.int32).tobytes()
            if len(text) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[text] = got
        return got

    def encode(self, text: str | None, cut=re.compile(r" +[^ \n▁]*|[^ \n▁]+|[\n▁]")) -> bytes:
        """The text's ids as native 32-bit integers."""
        if not text:
            return b""
        cache = self.cache
        return b"".join([cache.get(x) or self.stretch(x) for x in cut.findall(" " + text)])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The UTF-8 texts whose ids, ``lengths`` of each, stand in ``ids`` one after another."""
        other = len(self.piece_lengths) - 1
        ids = np.where((ids < 0) | (ids > other), other, ids)
        flat, got = ragged(self.piece_bytes, self.piece_lengths, ids)
        ends = np.concatenate([[0], np.cumsum(got)])[np.concatenate([[0], np.cumsum(lengths)])]
        raw = flat.tobytes()
        return [raw[a + raw.startswith(b" ", a, b) : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [k for k, f in enumerate(batch.schema) if f.name != name]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), values], [*(batch.schema.names[k] for k in kept), name])


def _steps(batch: pa.RecordBatch, column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values of ``column`` have about ``limit`` bytes at most."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", keep_text: bool = True, checked: str | None = None) -> DataFrame:
    """``docs`` (without ``text`` if so asked) with a column ``out``: the text's ids as little-endian 32-bit integers; and
    a column ``checked`` if named: whether the ids, decoded, are the text. One worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for part in _steps(batch, text):
                texts = part.column(text).to_pylist()
                ids = [m.encode(t) for t in texts]
                coded = _with(part, out, pa.array(ids, pa.binary()))
                if checked is not None:
                    back = m.decode(np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids], np.int64))
                    coded = _with(coded, checked, pa.array([(t or "").encode() == b for t, b in zip(texts, back, strict=True)], pa.bool_()))
                yield coded if keep_text else coded.select([x for x in coded.schema.names if x != text])
        m.cache.clear()  # Spark keeps the worker for other tasks

    schema = _appended(docs if keep_text else docs.drop(text), out, T.BinaryType())
    if checked is not None:
        schema = T.StructType([*(f for f in schema if f.name != checked), T.StructField(checked, T.BooleanType())])
    return map_batches(docs, run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with a column ``out``: the text of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for part in _steps(batch, ids):
                raw = [(x or b"")[: len(x or b"") // 4 * 4] for x in part.column(ids).to_pylist()]
                texts = m.decode(np.frombuffer(b"".join(raw), np.int32), np.array([len(x) // 4 for x in raw], np.int64))
                yield _with(part, out, pa.array([t.decode(errors="replace") for t in texts], pa.string()))

    return map_batches(encoded, run, _appended(encoded, out, T.StringType()))
