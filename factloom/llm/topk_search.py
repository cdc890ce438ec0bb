"""Exact top-k inner-product search over integer vectors.

Each vector of floats becomes integers, ``floor(1024 * x)``. All vectors are dealt into shards by descending length. An
orthogonal rotation (the right singular vectors of a bounded sample) moves most of each length into the first
coordinates, so that a sum over these, plus the product of the lengths of what is left (Cauchy-Schwarz), bounds an
inner product from above. A query first meets the longest vectors; the k-th score there is its threshold. It visits
only the shards whose longest vector, times its own length, reaches the threshold; there, blocks, then partial sums
with residual bounds, are held against the threshold, which rises on the way; what is left gets its exact score.

The sample and the longest vectors are of a fixed size (``SAMPLE``, ``HEAD``) and steer only the pruning: results are
exact over all rows. Queries of a shard are dealt in groups of about ``GROUP``, for each of which the shard is read.

Cases: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a null ``vec_id``;
shorter vectors count as filled with zeros; an empty vector has score 0 with any other. Rows that share a ``vec_id``
are candidates each, but never for a query of that id; of queries that share an id, one (of the smallest vector) is
asked. Components and scores beyond 64 bits are the greatest (or least) of 64 bits. With fewer than k candidates all come back. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialised, n_partitions

SAMPLE, HEAD, GROUP, SHARD, BLOCK, FIRST = 4096, 4096, 8192, 65536, 2048, 16
_HIT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``e`` (array of long), ``norm`` of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    e = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return kept.select("vec_id", e.alias("e")).withColumn("norm", norm)


def _matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as int64, filled with zeros up to ``d``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The k best (score, -vec_id) of each of some queries."""

    def __init__(self, n: int, k: int, threshold: np.ndarray):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.threshold = threshold.astype(np.float64).copy()

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[best], scores[best]
        if len(best) == self.k:
            self.threshold[q] = max(self.threshold[q], float(scores[best[-1]]))


def scan(best: Best, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, e: np.ndarray, rotation: np.ndarray) -> None:
    """Offers the candidates (sorted by descending length) to the queries."""
    if not len(ids) or not len(qids):
        return
    w = min(FIRST, rotation.shape[1])
    qf, qr = q.astype(np.float64), q @ rotation
    q_norm, q_rest = np.linalg.norm(qf, axis=1), np.linalg.norm(qr[:, w:], axis=1)
    for a in range(0, len(ids), BLOCK):
        block, own = e[a : a + BLOCK], ids[a : a + BLOCK]
        f = block.astype(np.float64)
        norms = np.linalg.norm(f, axis=1)
        slack = 1e-9 * q_norm * norms.max() + 1e-6
        live = np.flatnonzero(q_norm * norms.max() + slack >= best.threshold)
        if not len(live):
            continue
        r = f @ rotation
        bound = qr[live, :w] @ r[:, :w].T + np.outer(q_rest[live], np.linalg.norm(r[:, w:], axis=1))
        left = (bound + slack[live, None] >= best.threshold[live, None]) & (own[None, :] != qids[live, None])
        most = q_norm.max() * norms.max()
        small, wide = most < 2.0**52, most >= 2.0**62  # sums of doubles are exact; sums don't fit 64 bits
        for k in np.flatnonzero(left.any(axis=1)):
            c = np.flatnonzero(left[k])
            if wide:
                s = np.clip(block[c].astype(object) @ q[live[k]].astype(object), -(2**63), 2**63 - 1).astype(np.int64)
            else:
                s = (f[c] @ qf[live[k]]).astype(np.int64) if small else block[c] @ q[live[k]]
            ok = s >= best.threshold[live[k]]
            if ok.any():
                best.add(live[k], own[c[ok]], s[ok])


def _hits(best: Best, qids: np.ndarray) -> pa.Table:
    n = [len(x) for x in best.ids]
    cat = lambda x: np.concatenate(x) if len(x) else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(np.repeat(qids, n), pa.int64()), "vec_id": pa.array(cat(best.ids), pa.int64()), "score": pa.array(cat(best.scores), pa.int64())})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best of all ``vectors`` for each that is a query."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("d"), F.sum(is_query.cast("long")).alias("q")).first()
    n, d = facts.n, max(1, facts.d or 0)
    shards, groups = max(n_partitions(spark), -(-n // SHARD)), max(1, -(-(facts.q or 0) // GROUP))

    def table_of(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.select("vec_id", "e").toArrow()
        return got["vec_id"].to_numpy(), _matrix(got["e"], d) if len(got) else np.zeros((0, d), np.int64)

    _, sample = table_of(rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE))
    rotation = np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T if len(sample) else np.eye(d)
    head_ids, head = table_of(rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD))

    dealt = rows.repartitionByRange(shards, F.desc("norm"), "vec_id").withColumn("shard", F.spark_partition_id())
    index = materialised(dealt)
    longest = dict(index.groupBy("shard").agg(F.max("norm")).collect())  # a number for each shard
    steps = np.array([longest.get(s, -1.0) for s in range(shards)])
    reach = np.maximum.accumulate(steps[::-1])[::-1]  # the longest in this shard or a later one

    def first_look(batches):
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
            best = Best(len(ids), k, np.full(len(ids), -np.inf))
            for a in range(0, len(ids), 1024):
                part = Best(len(ids[a : a + 1024]), k, np.full(len(ids[a : a + 1024]), -np.inf))
                scan(part, ids[a : a + 1024], q[a : a + 1024], head_ids, head, rotation)
                best.threshold[a : a + 1024] = part.threshold
            norms = np.linalg.norm(q.astype(np.float64), axis=1)
            last = [int(np.count_nonzero(x * reach * (1 + 1e-9) + 1e-6 >= t)) - 1 if np.isfinite(t) else shards - 1 for x, t in zip(norms, best.threshold, strict=True)]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "e": batch.column(1), "threshold": pa.array(best.threshold), "last": pa.array(last, pa.int32())})

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("e").alias("e"))
    looked = asked.mapInArrow(first_look, "vec_id long, e array<bigint>, threshold double, last int").where("last >= 0")
    sent = looked.withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        best = Best(len(qids), k, left["threshold"].to_numpy() if len(qids) else np.zeros(0))
        if len(qids) and len(ids):
            order = np.lexsort((ids, -right["norm"].to_numpy()))
            e = _matrix(right["e"], d)[order]
            for a in range(0, len(qids), 1024):
                part = Best(len(qids[a : a + 1024]), k, best.threshold[a : a + 1024])
                scan(part, qids[a : a + 1024], _matrix(left["e"].slice(a, 1024), d), ids[order], e, rotation)
                best.ids[a : a + 1024], best.scores[a : a + 1024] = part.ids, part.scores
        return _hits(best, qids)

    found = sent.select("shard", "part", "vec_id", "e", "threshold").groupBy("shard", "part").cogroup(held.select("shard", "part", "vec_id", "e", "norm").groupBy("shard", "part")).applyInArrow(search, _HIT)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
