"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed n-grams of one to three characters of the lower-cased text, in which each run of characters
that aren't letters is as many spaces. A feature's value is its count times its inverse document frequency, over the
sum of these. Document frequencies are counted over all training documents. The weights are learnt from a bounded
sample of them (``PER_CLASS`` documents a language, ``SAMPLE`` in all) by follow-the-regularised-leader with an
elastic-net penalty, whose L1 part leaves most weights zero; a fifth of the sample is kept back to fit the temperature
that divides the scores.

Training documents are those whose ``crc32`` of the id as text leaves a remainder by five and whose language isn't null.

Cases: a null text, or one without a letter, is ``und`` with score 0; without training documents every text is ``und``.
Texts are read whole, however long, in slices. Each row is judged by itself, repeated or not. Other columns don't count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches
from factloom.llm.sampling import held_out, per_class_sample

FEATURES, ORDERS = 1 << 16, 3
PER_CLASS, SAMPLE = 1000, 6000
#: Characters that are unpacked at once.
SLICE = 1_000_000
SCALE = 40.0
UNDECIDED = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: itself if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    is_letter = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    out[is_letter] = np.flatnonzero(is_letter)
    return out


def _slices(texts: list[str | None]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of (document, slice with the characters that its last n-grams need, n-grams that begin in it)."""
    group: list[tuple[int, str, int]] = []
    size = 0
    for k, t in enumerate(texts):
        t = (t or "").lower()
        for a in range(0, len(t), SLICE):
            own = min(SLICE, len(t) - a)
            if group and size + own > SLICE:
                yield group
                group, size = [], 0
            group.append((k, t[a : a + own + ORDERS - 1], own))
            size += own
    if group:
        yield group


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of slices: (document of each slice, first position of each, letters in each, feature by order and position).

    A position where no n-gram of the order begins has the feature ``FEATURES``.
    """
    for group in _slices(texts):
        raw = np.frombuffer("\0\0".join(t for _, t, _ in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for _, t, _ in group])
        starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
        own = np.array([n for _, _, n in group])
        inside = np.zeros(len(raw) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + own, -1)
        begins = np.cumsum(inside[:-1]).astype(bool)
        held = np.zeros(len(raw) + 1, np.int8)
        np.add.at(held, starts, 1)
        np.add.at(held, starts + lengths, -1)
        held = np.cumsum(held[:-1]).astype(bool)
        c = _letters()[raw]
        letters = np.add.reduceat(((c != 32) & begins).astype(np.int64), starts)
        c = c.astype(np.uint64)
        out = np.full((ORDERS, len(c)), FEATURES, np.int32)
        h = np.zeros(len(c), np.uint64)
        for n in range(ORDERS):
            m = len(c) - n
            if m <= 0:
                break
            h[:m] = (h[:m] + c[n:]) * np.uint64(0x9E3779B97F4A7C15)
            ok = begins[:m] & held[n:]
            out[n, :m][ok] = ((h[:m] ^ (h[:m] >> np.uint64(29))) >> np.uint64(40 - n)).astype(np.int64)[ok] & (FEATURES - 1)
        yield np.array([k for k, _, _ in group]), starts, letters, out


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, its features, their counts) of each text that isn't empty."""
    whole: dict[int, np.ndarray] = {}
    for docs, starts, _, features in ngrams(texts):
        ends = np.append(starts[1:], features.shape[1])
        for k, a, b in zip(docs, starts, ends, strict=True):
            got = np.bincount(features[:, a:b].ravel(), minlength=FEATURES + 1)[:FEATURES]
            for j in [j for j in whole if j != k]:
                x = whole.pop(j)
                yield j, (f := np.flatnonzero(x)), x[f]
            whole[k] = whole[k] + got if k in whole else got
    for j, x in whole.items():
        yield j, (f := np.flatnonzero(x)), x[f]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature is, and the number of texts; over all of ``docs``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)  # the last counts the texts
        for batch in batches:
            for _, f, _ in counts(batch.column(0).to_pylist()):
                df[f] += 1
                df[FEATURES] += 1
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int32()), "n": pa.array(df[f], pa.int64())})

    rows = docs.select("text").mapInArrow(partial, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows["f"].to_numpy()] = rows["n"].to_numpy()
    return df[:FEATURES], int(df[FEATURES])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha=0.5, beta=1.0, l1=0.3, l2=0.05, epochs=4, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and class, bias of each class) by FTRL-proximal with an elastic-net penalty."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    penalty = np.full(FEATURES + 1, l1)
    penalty[FEATURES] = 0  # the bias

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        shrunk = np.sign(zf) * np.maximum(np.abs(zf) - penalty[f, None], 0)
        return -shrunk / ((beta + np.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, x = np.append(rows[k][0], FEATURES), np.append(rows[k][1], 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = x[:, None] * p
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha * w
            n[f] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, from 0.05 to 20."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        by_class = (weights * idf[:, None] * SCALE).T
        self.tables = np.append(np.vstack([idf[None], by_class]), np.zeros((len(languages) + 1, 1)), axis=1).astype(np.float32)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores by text and language, whether the text has a letter)."""
        sums = np.zeros((len(texts), len(self.tables)))
        letters = np.zeros(len(texts), np.int64)
        for docs, starts, has, features in ngrams(texts):
            np.add.at(letters, docs, has)
            for c, t in enumerate(self.tables):
                values = t[features[0]]
                for row in features[1:]:
                    values += t[row]
                np.add.at(sums[:, c], docs, np.add.reduceat(values, starts, dtype=np.float64))
        return sums[:, 1:] / np.maximum(sums[:, :1], 1e-12) + self.bias, letters > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        s, ok = self.scores(texts)
        s = s / self.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if o else UNDECIDED for b, o in zip(best, ok, strict=True)], np.where(ok, p.max(axis=1), 0.0)


def train(docs: DataFrame) -> Model:
    """A model of the training documents' languages."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = per_class_sample(rows.select("doc_id", "lang"), "lang", PER_CLASS, SAMPLE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = list(counts(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[k] for k, _, _ in got], pa.int64()), "lang": pa.array([langs[k] for k, _, _ in got], pa.string()), "f": pa.array([f for _, f, _ in got], pa.list_(pa.int32())), "n": pa.array([n for _, _, n in got], pa.list_(pa.int32()))})

    chosen = rows.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")  # SAMPLE ids at most
    found = chosen.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(features, "doc_id long, lang string, f array<int>, n array<int>")
    got = found.orderBy("doc_id", F.xxhash64("lang", "f", "n")).limit(2 * SAMPLE).toArrow()  # repeated ids may be many rows
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0), np.ones(FEATURES), 1.0)
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    index = {x: k for k, x in enumerate(languages)}
    labels = np.array([index[x] for x in got["lang"].to_pylist()])
    data = []
    for f, n in zip(got["f"], got["n"], strict=True):
        f = np.asarray(f.values)
        x = np.asarray(n.values) * idf[f]
        data.append((f, SCALE * x / x.sum()))
    shuffled = np.random.default_rng(11).permutation(len(data))
    kept = shuffled[: len(data) // 5]
    learnt = shuffled[len(kept) :]
    w, b = ftrl([data[k] for k in learnt], labels[learnt], len(languages))
    s = np.array([x @ w[f] + b for f, x in (data[k] for k in kept)]).reshape(len(kept), len(languages))
    return Model(languages, w, b, idf, temperature(s, labels[kept]))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (``doc_id`` unless given), ``lang_pred`` and ``score``; instead of columns of these names."""
    from pyspark.sql import types as T

    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score")]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = broadcast.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    unlike = "_" * (1 + max(map(len, keep), default=0))
    asked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(unlike))
    return map_batches(asked, run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is decided with a score of ``least`` or more."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = broadcast.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != UNDECIDED and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
