"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its shingles of ``SHINGLE`` words (of all its words, if it has fewer). A shingle weighs its
count times ``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``, ``df`` of all ``N`` documents with words holding it: from 1 for
what all have to 2 for what one has, so that a copied text counts for little less than an own one. Documents are *linked* if the weighted
Jaccard similarity of these is ``SIMILARITY`` or more; a *class* is a connected component of links.

1. Document frequencies: an exchange between batches of texts (see ``batches``).
2. Signatures: ``BANDS`` x ``ROWS`` consistent samples (gamma variates by quantile tables, drawn from hashes of shingle
   and sample number) make band keys. Texts of the same words are one node from here on.
3. Candidates share a band key. In each band's group, two leaders (the ends of an order by hash) are verified against
   all others: as many pairs as the group has members, twice. Groups that then still hold several components get other
   leaders, ``ROUNDS`` times in all or until no link is found, which only saves work for the next step.
4. Of each group that still holds several components, every pair across them is compared, in the first band that the
   pair shares. Members are split by total weight, as a pair of too different weights can't be similar, then by hash into
   parts of about ``PART_WEIGHT`` or ``PART_NODES``; two parts meet in a task. The work of a group of different texts of
   like weights grows with its square, the memory of a task doesn't.
5. Verification computes the similarity from both documents' shingles; in step 4, of the pairs that an upper bound by
   ``COLUMNS`` sums of weights leaves and that links found in the same task don't connect already.

So all links among pairs that share a band are found, or their ends are connected by others. A pair at the threshold
shares no band with a chance of ``(1 - 0.8 ** ROWS) ** BANDS``, 5 in a million.

Cases: null, empty and word-less texts are each a class of their own; whole texts are read; rows that share an id are
judged by their texts, and the class id is the least id in a class (a null id never is, but for a class of nulls).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import ANSWER, SENT, Words, answered, by_row, pack, rows_by_bucket, unpack, with_answers, word_batches, buckets_for
from factloom.llm.common import materialised, mix, odd_constants, rolling
from factloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 2
#: Times that the groups get leaders.
ROUNDS = 2
#: Total weight and number of the members of a part of a group, about.
PART_WEIGHT, PART_NODES = 200_000, 256
#: Sums of a document's weights, by hash, that bound a similarity.
COLUMNS = 512
#: Shingles that are sampled at once.
STEP = 400_000
_SIGNED = np.int64


@functools.lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """65536 quantiles of Gamma(2, 1), and their logarithms."""
    p = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros(65536), np.full(65536, 60.0)
    for _ in range(70):  # P(x) = 1 - (1 + x) exp(-x)
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent samples (32 bits of each) of each document, whose elements begin at ``starts``."""
    quantile, log_quantile = _gamma()
    out = np.zeros((count, len(starts)), np.uint32)
    log_w = np.log(weights).astype(np.float32)
    place = np.arange(len(shingles), dtype=np.uint64)
    for k, c in enumerate(odd_constants(count, 77)):
        h = shingles * c
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        r = quantile[(h >> np.uint64(48)).view(_SIGNED)]
        log_a = log_quantile[((h >> np.uint64(32)) & np.uint64(0xFFFF)).view(_SIGNED)]
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32)
        beta /= np.float32(65536)
        t = np.floor(log_w / r + beta)
        log_a -= r * (t - beta + np.float32(1))
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        ordered <<= np.uint64(32)
        ordered |= place  # of equal samples, that of the smaller hash
        won = (np.minimum.reduceat(ordered, starts) & np.uint64(0xFFFFFFFF)).view(_SIGNED)
        out[k] = mix(h[won] ^ (t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """Band keys by document and band."""
    out = np.zeros((sampled.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(sampled.shape[1], np.uint64(b + 1))
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sampled[b * ROWS + r])
        out[:, b] = key
    return out.view(_SIGNED)


def sorted_by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order by ``major``, then ``minor``, which has 48 bits."""
    if len(major) and major.max() >= 1 << 16:
        return np.lexsort((minor, major))
    return np.argsort(major.astype(np.uint64) << np.uint64(48) | minor)


class Shingles:
    """A batch's distinct shingles of each document: ``doc``, ``hash``, ``count``; and its distinct hashes, by bucket."""

    def __init__(self, words: Words, size: int, buckets: int):
        h = words.hashes(3)
        n = len(h) - size + 1
        at = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        hashes, docs = [rolling(h, size, 21)[at]], [words.doc[at]]
        place = np.arange(len(h)) - (words.ends - words.counts)[words.doc] if len(h) else np.zeros(0, np.int64)
        full = np.flatnonzero(words.counts)
        whole = np.add.reduceat(mix(h + mix(place.astype(np.uint64) + np.uint64(9))), (words.ends - words.counts)[full]) if len(full) else np.zeros(0, np.uint64)
        self.node = np.zeros(len(words.counts), np.uint64)
        self.node[full] = mix(whole + words.counts[full].astype(np.uint64))
        short = full[words.counts[full] < size]
        hashes.append(self.node[short])
        docs.append(short)
        hashes, docs = np.concatenate(hashes) >> np.uint64(16), np.concatenate(docs)  # 48 bits
        order = sorted_by(docs, hashes)
        hashes, docs = hashes[order], docs[order]
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]))) if len(order) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(first, len(order)))
        self.hash, self.doc = hashes[first], docs[first]
        self.starts = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1])) if len(first) else np.zeros(0, np.int64)
        bucket = (self.hash % np.uint64(buckets)).astype(np.int64)
        self.order = sorted_by(bucket, self.hash)
        bucket, value = bucket[self.order], self.hash[self.order]
        new = np.append(True, (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])) if len(value) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.values, self.bucket = value[at], bucket[at]
        self.docs_with = np.diff(np.append(at, len(value))).astype(np.uint32)

    def weights(self, row: dict, total: int) -> np.ndarray:
        df = np.zeros(len(self.hash), np.int64)
        df[self.order] = answered(row, 0, self.bucket, np.uint32)[self.group]
        return self.count * (1 + np.log((1 + total) / (1 + df)) / np.log(1 + total))


def _sent(values: np.ndarray, docs: np.ndarray) -> bytes:
    gaps = pack(np.diff(values, prepend=np.uint64(0)))
    return len(gaps).to_bytes(4, "little") + gaps + pack(docs)


def frequencies(batches: DataFrame, size: int, buckets: int) -> DataFrame:
    """Answers to each batch: in how many documents each of its distinct shingles is."""

    def send(row: dict) -> pa.RecordBatch:
        s = Shingles(Words(row), size, buckets)
        return rows_by_bucket(row["batch"], s.bucket, lambda i, j: _sent(s.values[i:j], s.docs_with[i:j]))

    def add(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        values, docs = [], []
        for x in table["payload"]:
            raw = x.as_py()
            cut = 4 + int.from_bytes(raw[:4], "little")
            values.append(np.cumsum(unpack(raw[4:cut], np.uint64)))
            docs.append(unpack(raw[cut:], np.uint32))
        values, docs = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(values, kind="stable")
        v = values[order]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        df = np.zeros(len(v), np.uint32)
        df[order] = np.repeat(np.add.reduceat(docs[order], starts), np.diff(np.append(starts, len(v))))
        ends = np.cumsum(n)
        return pa.table({"bucket": table["bucket"], "batch": table["batch"], "answer": pa.array([pack(df[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary())})

    return batches.mapInArrow(by_row(send), SENT).groupBy("bucket").applyInArrow(add, ANSWER)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted distinct keys, weights) each."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = float(np.minimum(a[1][same], b[1][at][same]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def _vector(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    gaps = pack(np.diff(hashes, prepend=np.uint64(0)))
    return len(gaps).to_bytes(4, "little") + gaps + pack(weights.astype(np.float32))


def _read_vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    return np.cumsum(unpack(raw[4:cut], np.uint64)), unpack(raw[cut:], np.float32).astype(np.float64)


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of nodes whose vectors are as similar as ``threshold``.

    Pairs meet in groups of one ``a`` and a salt, that node's vector with each: a node with very many pairs is many groups.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_NODES).alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    wanted = salted.select("a", "salt", F.col("b").alias("node")).unionByName(salted.select("a", "salt", F.col("a").alias("node")).distinct())

    def check(table: pa.Table) -> pa.Table:
        a = table["a"][0].as_py()
        nodes = table["node"].to_pylist()
        raw = [x.as_py() for x in table["vector"]]
        own = _read_vector(raw[nodes.index(a)]) if a in nodes else None
        found = [n for n, x in zip(nodes, raw, strict=True) if own is not None and n != a and similarity(own, _read_vector(x)) >= threshold]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return wanted.join(vectors, "node").groupBy("a", "salt").applyInArrow(check, "a long, b long")


def stars(placed: DataFrame, seed: int, threshold: float) -> DataFrame:
    """In each group of ``placed`` (``key``, ``node``, ``weight``, ``component``) that holds several components, two nodes
    paired with all others that are of another component and of a similar weight: pairs of leader ``a`` and ``b``."""
    me = F.struct("node", "component", "weight")
    by = F.xxhash64("node", F.lit(seed))  # the same order in all groups, so that groups of the same nodes share leaders
    led = placed.groupBy("key").agg(F.min_by(me, by).alias("p"), F.max_by(me, by).alias("q"), F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key", F.explode(F.array("p", "q")).alias("x"))
    alike = (F.col("weight") >= threshold * F.col("x.weight") * (1 - 1e-6)) & (F.col("x.weight") >= threshold * F.col("weight") * (1 - 1e-6))
    joined = placed.join(led, "key").where((F.col("x.component") != F.col("component")) & alike)
    return joined.select(F.col("x.node").alias("a"), F.col("node").alias("b")).distinct()


def across(members: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, parts: np.ndarray | None, keys: np.ndarray, band: int, threshold: float) -> list[tuple[int, int]]:
    """Places of the similar pairs of ``members`` (sorted distinct hashes and weights each) of different ``labels``, but
    for pairs that those returned connect; with ``parts``, pairs across them only. Pairs that share a key (0: none) of a
    band before ``band`` are left to that band's group."""
    n = len(members)
    total = np.array([w.sum() for _, w in members])
    sums = np.zeros((n, COLUMNS), np.float32)
    for k, (h, w) in enumerate(members):
        sums[k] = np.bincount((h % np.uint64(COLUMNS)).astype(np.int64), w, COLUMNS)
    labels = np.unique(labels, return_inverse=True)[1]
    found = []
    for i in range(n - 1):
        j = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        if parts is not None:
            j = j[parts[j] != parts[i]]
        j = j[(total[j] >= threshold * total[i] * (1 - 1e-6)) & (total[i] >= threshold * total[j] * (1 - 1e-6))]
        j = j[~((keys[j, :band] == keys[i, :band]) & (keys[i, :band] != 0)).any(axis=1)]
        if not len(j):
            continue
        most = np.minimum(sums[j], sums[i]).sum(axis=1)
        for k in j[most >= threshold / (1 + threshold) * (total[j] + total[i]) * (1 - 1e-4)].tolist():
            if labels[k] != labels[i] and similarity(members[i], members[k]) >= threshold:
                found.append((i, k))
                labels[labels == labels[k]] = labels[i]
    return found


def rest(placed: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Links (``a``, ``b``) among all pairs of ``placed`` (``key``, ``band``, ``node``, ``weight``, ``component``) that share a key and
    are of different components, as far as other links don't connect them. Leaders met all others in groups of up to three."""
    keys = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n")).where("c <> d and n > 3").select("key")
    # similar nodes are of the same rank or of adjacent ones
    rank = F.floor(F.log("weight") / (float(np.log(1 / threshold)) + 1e-5)).cast("int")
    left = materialised(placed.join(keys, "key").withColumn("rank", rank))
    parts = left.groupBy("key", "rank").agg(F.greatest(F.ceil(F.sum("weight") / PART_WEIGHT), F.ceil(F.count("*") / PART_NODES)).cast("int").alias("parts"), F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    up, down = (parts.select("key", (F.col("rank") + by).alias("rank"), F.col("parts").alias(f"parts{by}"), F.col("members").alias(f"members{by}")) for by in (-1, 1))
    counts = parts.join(up, ["key", "rank"], "left").join(down, ["key", "rank"], "left")
    # tasks of a node: those of its part with each part of its rank, and of the rank above and below
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(0)) - 1)
    meet = lambda step, a, b: F.struct((F.col("rank") + min(step, 0)).alias("rank"), F.lit(abs(step)).alias("step"), ((a != b) | F.lit(step != 0)).alias("two"), a.alias("i"), b.alias("j"), (own if step >= 0 else own + (1 << 24)).alias("part"))
    same = F.when((F.col("members") > 1) & (F.col("low") != F.col("high")), F.transform(upto(F.col("parts")), lambda k: meet(0, F.least(own, k), F.greatest(own, k))))
    above = F.when(F.col("parts-1").isNotNull(), F.transform(upto(F.col("parts-1")), lambda k: meet(1, own, k)))
    below = F.when(F.col("parts1").isNotNull(), F.transform(upto(F.col("parts1")), lambda k: meet(-1, k, own)))
    empty = F.expr("array()").cast("array<struct<rank:int,step:int,two:boolean,i:int,j:int,part:int>>")
    tasks = F.concat(*(F.coalesce(t, empty) for t in (same, above, below)))
    spread = left.join(counts, ["key", "rank"]).select("key", "band", "node", "component", F.explode(tasks).alias("t"))
    meetings = spread.groupBy("node").agg(F.collect_set(F.struct("band", "key")).alias("keys"), F.first("component").alias("component"), F.collect_list(F.struct("key", "band", "t")).alias("met"))
    wanted = meetings.join(vectors, "node").select("node", "component", "keys", "vector", F.explode("met").alias("m"))
    wanted = wanted.select("node", "component", "keys", "vector", "m.key", "m.band", "m.t.rank", "m.t.step", "m.t.two", "m.t.i", "m.t.j", "m.t.part")

    def check(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        shared = np.zeros((len(nodes), BANDS), np.int64)
        for k, own_keys in enumerate(table["keys"].to_pylist()):
            for x in own_keys:
                shared[k, x["band"]] = x["key"]
        members = [_read_vector(x.as_py()) for x in table["vector"]]
        found = across(members, table["component"].to_numpy(), table["part"].to_numpy() if table["two"][0].as_py() else None, shared, table["band"][0].as_py(), threshold)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[k] for _, k in found], pa.int64())})

    return wanted.groupBy("key", "rank", "step", "i", "j").applyInArrow(check, "a long, b long")


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``node`` (a hash of the words; null without any) and ``class_id`` of each row of ``docs``."""
    spark = docs.sparkSession
    batches = word_batches(docs)
    total = batches.agg(F.sum(F.expr("aggregate(counts, 0L, (n, x) -> n + if(x > 0, 1L, 0L))"))).first()[0] or 0
    buckets = buckets_for(batches)
    answers = materialised(frequencies(batches, size, buckets))

    def sign(row: dict) -> pa.RecordBatch:
        s = Shingles(Words(row), size, buckets)
        w = s.weights(row, total)
        n = len(row["counts"])
        keys, weight = np.zeros((n, BANDS), np.int64), np.zeros(n)
        ends = np.append(s.starts[1:], len(s.hash)) if len(s.starts) else s.starts
        a = 0
        while a < len(s.starts):  # documents of about STEP shingles together
            b = max(a + 1, int(np.searchsorted(ends, s.starts[a] + STEP, side="right")))
            part = slice(s.starts[a], ends[b - 1])
            keys[s.doc[s.starts[a:b]]] = bands(samples(s.hash[part], w[part], s.starts[a:b] - s.starts[a], BANDS * ROWS))
            a = b
        if len(s.starts):
            weight[s.doc[s.starts]] = np.add.reduceat(w, s.starts)
        has = weight > 0
        node = pa.array(s.node.view(np.int64), mask=~has)
        return pa.RecordBatch.from_arrays([pa.array([row["batch"]] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), node, pa.array(weight), pa.array(list(keys), pa.list_(pa.int64()))], ["batch", "place", "doc_id", "node", "weight", "bands"])

    signed = materialised(with_answers(batches, answers).mapInArrow(by_row(sign), "batch long, place int, doc_id long, node long, weight double, bands array<bigint>"))
    known = signed.where("node is not null")
    nodes = known.groupBy("node").agg(F.min(F.struct("batch", "place")).alias("at"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    member = materialised(nodes.select("node", "weight", "at", F.posexplode("bands").alias("band", "key")))
    pairs = materialised(stars(member.select("key", "node", "weight", F.col("node").alias("component")), 0, threshold))

    # vectors of the nodes that share a band with another
    crowded = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = member.join(crowded, "key")
    asked = shared.select("node").distinct()
    places = asked.join(member.select("node", "at").distinct(), "node").groupBy(F.col("at.batch").alias("batch")).agg(F.collect_list("at.place").alias("places"))

    def vector(row: dict) -> pa.RecordBatch:
        s = Shingles(Words(row), size, buckets)
        w = s.weights(row, total)
        first = dict(zip(s.doc[s.starts].tolist(), zip(s.starts.tolist(), [*s.starts[1:].tolist(), len(s.hash)], strict=True), strict=True))
        spans = [(d, *first[d]) for d in row["places"]]
        return pa.RecordBatch.from_pydict({"node": pa.array([int(s.node.view(np.int64)[d]) for d, _, _ in spans], pa.int64()), "vector": pa.array([_vector(s.hash[a:b], w[a:b]) for _, a, b in spans], pa.binary())})

    vectors = materialised(with_answers(batches, answers).join(places, "batch").mapInArrow(by_row(vector), "node long, vector binary"))
    links = materialised(verified(pairs, vectors, threshold))
    found = components(links)
    label = F.coalesce("component", "node").alias("component")
    place = lambda: shared.select("key", "band", "node", "weight").join(found, "node", "left").select("key", "band", "node", "weight", label)
    for seed in range(1, ROUNDS):  # other leaders for the groups that still hold several components
        placed = place()
        new = materialised(stars(placed, seed, threshold).join(pairs, ["a", "b"], "left_anti"))
        more = materialised(verified(new, vectors, threshold))
        if more.isEmpty():
            break
        pairs, links = pairs.unionByName(new), links.unionByName(more)
        found = components(links)
    more = materialised(rest(place(), vectors, threshold))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = known.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", label)
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    of_node = named.join(least, "component").select("node", "class_id")
    return signed.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, of least ``doc_id`` of each class; of rows equal in id and text, one."""
    from pyspark.sql import Window

    row = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    found = classes(docs.select(row.alias("doc_id"), "text"), size, threshold).select(F.col("doc_id").alias("row"), "class_id").distinct()
    ids = docs.select(row.alias("row"), "doc_id").distinct()
    kept = materialised(ids.join(found, "row").groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.row").alias("row")))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), row.alias("row"))
    # rows that differ, though their hashes don't, all stay
    number = F.row_number().over(Window.partitionBy("row", "d.doc_id", F.hash("d.text")).orderBy("row"))
    return d.join(kept, "row", "left_semi").withColumn("number", number).where("number = 1").select("d.*")
