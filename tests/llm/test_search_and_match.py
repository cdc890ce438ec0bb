import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import decontaminate
from factloom.llm.decontaminate import Matcher, budget, myers, normal, normal_many
from factloom.llm.topk_search import top_k
from tests.llm.data import documents, frame, text


def distance(item, window):
    before = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(window, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


def test_myers():
    r = random.Random(1)
    for _ in range(150):
        item, window = (bytes(r.choice(b"abc ") for _ in range(r.randint(a, 60))) for a in (1, 0))
        assert myers(item, window)[0] == distance(item, window)


def test_matches_by_brute_force(spark):
    r = random.Random(3)
    items = [(k, text(r, r.randint(8, 30))) for k in range(6)] + [(90, "Short one"), (91, None), (92, "..."), (93, "")]
    docs = documents(n=20)
    for k in range(12):
        t = list(r.choice(items[:6])[1])
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = r.choice("xyz é")
        docs.append((7000 + k, f"{text(r, 15)} {''.join(t)} {text(r, 15)}"))
    docs += [(8000, "a SHORT, one!"), (8001, "shorty one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.matches(frame(spark, docs), bench).collect()}
    expected = {}
    for d, t in docs:
        for i, x in items:
            a, b = normal(x), normal(t)
            if a and len(b) < 40_000:
                n = distance(a, b) if len(a) >= 15 else 0 if f" {a.decode()} " in f" {b.decode()} " else 99
                if n <= budget(len(a)):
                    expected[d, i] = n
    assert got == expected and len({v for v in got.values()}) > 2
    df = frame(spark, docs).withColumn("item_id", F.lit(5))
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontaminate.matches(frame(spark, []), bench).count() == decontaminate.matches(df, bench.limit(0)).count() == 0


def test_items_without_an_id_are_cleaned_too(spark):
    bench = spark.createDataFrame([(None, "a sentence of the benchmark"), (2, "another one of its sentences")], "item_id long, text string")
    docs = frame(spark, [(1, "with a sentence of the benchmark in it"), (2, "nothing at all"), (3, "and another one of its sentences")])
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == [(1, None), (3, 2)]


def test_scores_beyond_64_bits_are_the_greatest(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (4, [3e6, 3e6]), (100, [3e6, 2.0])]
    got = {(r.query_id, r.vec_id): r.score for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()}
    e = {k: [min(max(int(np.floor(1024 * x)), -(2**63)), 2**63 - 1) for x in v] for k, v in rows}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    assert got == {(q, k): clip(sum(a * b for a, b in zip(e[q], e[k], strict=True))) for q in (0, 100) for k in e if k != q}


def test_normal_forms_agree():
    for t in ("A  b,C_d", "É-x ß", "", "  ", "x\u0000y"):
        assert normal_many([t.encode()]) == [normal(t)]
    assert Matcher([]).search([b"anything"]) == []


def test_top_k_by_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in r.normal(0, 1, 8).astype(np.float32)]) for k in range(0, 600)]
    rows += [(700 + k, rows[5][1]) for k in range(40)] + [(800, [0.0] * 8), (900, [1.0, 2.0]), (5, [9.0] * 8)]
    bad = [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).repartition(4)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0, 10).collect()))
    e = {k: np.floor(1024.0 * np.array([*v, *[0.0] * (8 - len(v))], np.float32).astype(float)).astype(int) for k, v in rows[:-1]}
    pairs = [*e.items(), (5, np.floor(1024.0 * np.full(8, 9.0)).astype(int))]
    expected = []
    for q in [k for k in e if k % 100 == 0]:
        best = sorted((-int(e[q] @ v), k) for k, v in pairs if k != q)[:10]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == sorted(expected)
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id in (100, 200, 300)")
    assert sorted(map(tuple, top_k(few, F.col("vec_id") == 100).select("query_id", "vec_id").collect())) == [(100, 200), (100, 300)]
