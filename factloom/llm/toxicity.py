"""Toxicity: embeddings of subwords, averaged, under a linear softmax, learnt together.

A word is its lower-cased letters and digits; its subwords are itself and its character n-grams of three to six with
marks at both ends, hashed. A word's vector is the mean of its subwords', a text's the mean of its words', and a linear
softmax over two classes reads that. Embeddings and softmax are trained together in numpy (Adagrad over small batches,
with early stopping on a part of the sample kept back) on a bounded sample of labelled documents (``PER_CLASS`` of
either label); the bias is then set for the labels' true shares. A misspelling shares n-grams, and so their vectors.

Averages and softmax are linear up to the last step, so a trained model is one number per subword; a worker adds them
up once for each distinct word of a batch.

A subword that fewer than ``MIN_TEXTS`` texts of the sample hold keeps the zero vector, so a word that the sample has
seldom speaks through the n-grams that it shares with others only; with a label table of a few dozen toxic texts, only
n-grams that recur in as many of them count.

Cases: a text that is null, empty or without a word gets the score of the bias alone; whole texts are read, however
long; each row is judged by itself. Without labelled training documents every score is 0. A document with several labels
counts as toxic if one says so; labels without a document, and null labels, do nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, mix, ragged
from factloom.llm.sampling import held_out, per_class_sample

BUCKETS, WIDTH = 1 << 17, 8
PER_CLASS = 1600
ORDERS = (3, 4, 5, 6)
SCALE = 60.0
#: Words of the zero vector that each text's mean counts besides its own, so that one word of a short text says less.
PAD = 8
#: A subword of fewer texts of the sample keeps the zero vector: it would only help to learn those texts by heart.
MIN_TEXTS = 8
_WORD = re.compile(r"[^\W_]+")


def bag(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order of the texts, words in each text)."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = _WORD.findall(t.lower()) if t else []
        counts[k] = len(own)
        words += own
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words' subwords one after another, number of each word's)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    offset = np.cumsum(lengths) - lengths
    h = np.zeros(len(c), np.uint64)
    owners, found = [], []
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(c) - n + 1)
        h = (h[:m] + c[n - 1 :][:m]) * np.uint64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            ok = np.flatnonzero(word[:m] == word[n - 1 :][:m]) if m else np.zeros(0, np.int64)
            owners.append(word[ok])
            found.append(mix(h[ok] + np.uint64(n)))
    # the whole word: a sum that depends on every character and its place
    place = np.arange(len(c)) - offset[word] if len(words) else np.zeros(0, np.int64)
    total = np.add.reduceat(mix(c * np.uint64(0x100000001) + place.astype(np.uint64)), offset) if len(words) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(words)))
    found.append(mix(total))
    owner, bucket = np.concatenate(owners), (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their weights in the mean) of each text."""
    words, index, counts = bag(texts)
    buckets, lengths = subwords(words)
    out = []
    a = 0
    for n in counts:
        own, times = np.unique(index[a : a + n], return_counts=True)
        a += n
        flat, got = ragged(buckets, lengths, own)
        weight = np.repeat(times / (got * (n + PAD)), got)
        b, at = np.unique(flat, return_inverse=True)
        out.append((b, np.bincount(at, weight, minlength=len(b))))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs=8, batch=32, rate=0.2, seed=5) -> tuple[np.ndarray, float]:
    """(a number per bucket, the bias): the difference of the two classes' scores."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
    known = np.zeros(BUCKETS, np.int64)
    for f, _ in rows:
        known[f] += 1
    rare = known < MIN_TEXTS
    embed[rare] = 0
    for k, (f, x) in enumerate(rows):  # in place, as memory is short on a driver
        rows[k] = (f[~rare[f]], x[~rare[f]])
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_s, seen_b = np.full((BUCKETS, 1), 1e-8, np.float32), np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    order = rng.permutation(len(rows))
    kept, learnt = order[: len(rows) // 6], order[len(rows) // 6 :]

    def forward(which: np.ndarray):
        f = np.concatenate([rows[k][0] for k in which])
        x = (SCALE * np.concatenate([rows[k][1] for k in which])).astype(np.float32)
        n = np.array([len(rows[k][0]) for k in which])
        hidden = np.zeros((len(which), WIDTH), np.float32)
        full = np.flatnonzero(n)
        hidden[full] = np.add.reduceat(embed[f] * x[:, None], (np.cumsum(n) - n)[full], axis=0) if len(f) else 0
        s = hidden @ soft + bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return f, x, n, hidden, p / p.sum(axis=1, keepdims=True)

    def loss() -> float:
        if not len(kept):
            return 0.0
        total = 0.0
        for a in range(0, len(kept), 128):
            part = kept[a : a + 128]
            total -= float(np.log(np.maximum(forward(part)[4][np.arange(len(part)), labels[part]], 1e-9)).sum())
        return total / len(kept)

    best = (np.inf, embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    since = 0
    for _ in range(epochs):
        if since == 2:
            break
        rng.shuffle(learnt)
        for a in range(0, len(learnt), batch):
            part = learnt[a : a + batch]
            f, x, n, hidden, p = forward(part)
            g = p
            g[np.arange(len(part)), labels[part]] -= 1
            g /= len(part)
            g_soft, g_bias = hidden.T @ g, g.sum(axis=0)
            g_hidden = g @ soft.T
            used, at = np.unique(f, return_inverse=True)
            g_rows = np.repeat(g_hidden, n, axis=0) * x[:, None]
            g_embed = np.stack([np.bincount(at, g_rows[:, j], minlength=len(used)) for j in range(WIDTH)], axis=1)
            seen_e[used] += (g_embed**2).mean(axis=1, keepdims=True)
            embed[used] -= rate * g_embed / np.sqrt(seen_e[used])
            seen_s += g_soft**2
            soft -= rate * 0.1 * g_soft / np.sqrt(seen_s)
            seen_b += g_bias**2
            bias -= rate * 0.1 * g_bias / np.sqrt(seen_b)
        now, since = loss(), since + 1
        if now < best[0] or not len(kept):
            since, best = 0, (now, embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    return best[1].astype(np.float64) * SCALE, best[2]


class Model:
    def __init__(self, table: np.ndarray, bias: float, trained: bool = True):
        self.table, self.bias, self.trained = table.astype(np.float32), bias, trained

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the label 1."""
        if not self.trained:
            return np.zeros(len(texts))
        words, index, counts = bag(texts)
        means = np.zeros(0)
        if words:
            buckets, lengths = subwords(words)
            means = np.add.reduceat(self.table[buckets].astype(np.float64), np.cumsum(lengths) - lengths) / lengths
        total = np.concatenate([[0.0], np.cumsum(means[index])])
        ends = np.cumsum(counts)
        s = (total[ends] - total[ends - counts]) / (counts + PAD) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    marked = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = dict(marked.groupBy("toxic").count().collect())
    sample = per_class_sample(marked, "toxic", PER_CLASS, 2 * PER_CLASS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2).to_pylist()
            for own, part in chunks(keys, [(t or "").encode() for t in texts], 2_000_000):
                got = features([t.decode() for t in part])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in own], pa.int64()), "toxic": pa.array([k for _, k in own], pa.int32()), "f": pa.array([f for f, _ in got], pa.list_(pa.int32())), "x": pa.array([x for _, x in got], pa.list_(pa.float32()))})

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # 2 * PER_CLASS rows at most
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    got = chosen.mapInArrow(extract, "doc_id long, toxic int, f array<int>, x array<float>").toArrow().sort_by("doc_id")
    y = got["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, trained=False)
    rows = [(np.asarray(f.values), np.asarray(x.values)) for f, x in zip(got["f"], got["x"], strict=True)]
    del got
    table, bias = fit(rows, y)
    return Model(table, bias + float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each row of ``docs``."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, batch.schema.field(0).type), "score": pa.array(broadcast.value.scores([t.decode() for t in texts]))})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
