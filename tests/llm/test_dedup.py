import collections
import hashlib
import math
import random

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import line_dedup, near_dedup, queries, substring_dedup
from tests.llm.data import documents, frame


def substring_brute(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    rows = documents() + documents(5, 10)  # ids repeat
    for window in (13, 5):
        got = substring_dedup.remove_repeats(frame(spark, rows).withColumn("batch", F.lit(1)), window)
        assert sorted(map(tuple, got.collect())) == substring_brute(rows, window)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    text = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(frame(spark, rows), with_text=True).collect()}
    assert text[2003] == "one" and text[2000] == ""


def line_brute(rows, t, least):
    """Removed line numbers by document; ``doc_id``s must differ."""
    lines = sorted(((d, k, frozenset(w for w in x.replace("\t", " ").replace("\r", " ").split(" ") if w)) for d, text in rows if text is not None for k, x in enumerate(text.split("\n"))), key=lambda x: x[:2])
    out = {d: (0 if text is None else text.count("\n") + 1, []) for d, text in rows}
    for j, (d, k, s) in enumerate(lines):
        if len(s) >= least and any(len(o) >= least and len(s & o) >= t * len(s | o) - 1e-9 for _, _, o in lines[:j]):
            out[d][1].append(k)
    return out


def test_line_dedup(spark):
    rows = documents(n=24) + [(5000 + k, "a b c d e f g h i " + "xyz"[k % 3] + "\n\nshort line\na b\tc d e") for k in range(9)]
    df = frame(spark, rows).withColumn("at", F.lit(1)).withColumn("removed", F.lit("x"))
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.decisions(df).collect()}
    assert got == line_brute(rows, 0.8, 5)
    kept = line_dedup.without_repeats(df)
    assert kept.columns == df.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    for d, t in rows:
        assert texts[d] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[d][1]))


def test_line_dedup_of_repeated_and_no_rows(spark):
    rows = [(1, "a b c d e\na b c d e f"), (1, "a b c d e\na b c d e f"), (None, "a b c d e")]
    got = sorted((r.doc_id is not None, r.removed) for r in line_dedup.decisions(frame(spark, rows)).collect())
    assert got == [(False, []), (True, [0, 1])]
    assert line_dedup.without_repeats(frame(spark, rows)).count() == 3
    assert line_dedup.decisions(frame(spark, [])).count() == 0


def test_short_lines_are_judged_by_the_query_and_the_pipeline(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, "\n".join(" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 6))) for _ in range(8))) for k in range(40)]
    rows += [(100, "Menu\nHome\n\n \t"), (101, "Home\nMenu\n\n \t"), (102, "漢字だけの行\na a a b"), (103, "漢字だけの行\nb a\nnew"), (104, None), (105, "")]
    expected = line_brute(rows, 0.8, 1)
    assert expected[101] == (4, [0, 1])
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.n_lines, [int(k) for k in x.removed_lines.split(",") if k]) for x in got} == expected
    kept = {x.doc_id: x.text for x in corpus_pipeline.lines(spark, frame(spark, rows), "").collect()}
    assert kept == {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected[d][1]) for d, t in rows}


def test_line_dedup_of_crowds_and_its_second_round(spark, monkeypatch):
    r = random.Random(3)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for k in range(400):  # all share words; some are like the first line, others like each other only
        words = list(base)
        for at in r.sample(range(40), r.choice([1, 3, 5, 8])):
            words[at] = f"v{r.randrange(60)}"
        rows.append((k, " ".join(words)))
    long = [f"l{k}" for k in range(300)]  # over LONG words
    rows += [(1000 + k, " ".join(w if r.random() < 1 - k / 100 else f"o{r.randrange(10**6)}" for w in long)) for k in range(20)]
    calls = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, docs, t: calls.append(pairs.count()) or verified(pairs, docs, t))
    got = {x.doc_id: (x.n_lines, x.removed) for x in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == line_brute(rows, 0.8, 5)
    assert len(calls) == 2 and calls[1] > 0  # pairs that the first round skipped


def test_line_dedup_verifies_few_pairs_of_a_crowd(spark, monkeypatch):
    r = random.Random(5)
    rare, own, other = ([f"{x}{k}" for k in range(n)] for x, n in (("rare", 12), ("c", 44), ("d", 40)))
    rows = [(0, " ".join(rare + other)), (1, "\n".join([" ".join(own), " ".join(other)] * 300))]  # first at all rare words, and unlike the crowd
    for k in range(120):
        words = rare + own
        words[r.randrange(12, 56)] = f"v{k}"
        rows.append((100 + k, " ".join(words)))
    calls = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, docs, t: calls.append(pairs.count()) or verified(pairs, docs, t))
    got = {x.doc_id: (x.n_lines, x.removed) for x in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == line_brute(rows, 0.8, 5)
    assert sum(calls) <= 2 * len(rows)  # not one for each two lines of the crowd


def near_brute(rows, size, t):
    counts = {}
    for d, text in rows:
        w = (text or "").encode().split()
        counts[d] = collections.Counter([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else []))
    df = collections.Counter(s for c in counts.values() for s in c)
    n = sum(1 for c in counts.values() if c)
    weight = {d: {s: x * (1 + math.log((1 + n) / (1 + df[s])) / math.log(1 + n)) for s, x in c.items()} for d, c in counts.items()}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in weight:
        for b in weight:
            if a < b and weight[a] and weight[b]:
                shared = sum(min(x, weight[b][s]) for s, x in weight[a].items() if s in weight[b])
                if shared >= t * (sum(weight[a].values()) + sum(weight[b].values()) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in root}


def test_near_dedup(spark):
    rows = documents(7, 60)
    expected = near_brute(rows, 5, 0.8)
    df = frame(spark, rows).withColumn("node", F.lit(1)).withColumn("row", F.lit("x"))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == expected and len(set(got.values())) < len(got)
    again = df.unionByName(df.limit(5))
    kept = near_dedup.one_of_each(again)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert near_dedup.classes(frame(spark, [])).count() == 0


def crowd(copies, seed=11, first=0):
    """(doc_id, text): an original, copies with two other words each (similar to it, not to each other), and longer ones."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    out = [(first, " ".join(words))]
    for k in range(copies):
        t = list(words)
        for at in (r.randrange(5, 95), r.randrange(105, 195)):
            t[at] = f"own{first}x{k}x{at}"
        out.append((first + 1 + k, " ".join(t)))
    out += [(first + 1 + copies + k, " ".join([*words, *(f"tail{first}x{k}x{i}" for i in range(4 * k))])) for k in range(1, 20)]
    return out


def test_near_dedup_of_an_original_with_hundreds_of_edited_copies(spark, monkeypatch):
    rows = crowd(330)
    expected = near_brute(rows, 5, 0.8)
    assert {expected[k] for k in range(331)} == {0} and len(set(expected.values())) > 1
    assert len(set(near_brute(rows[1:331], 5, 0.8).values())) > 100  # the copies are held together by the original
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()} == expected
    monkeypatch.setattr(near_dedup, "PART_NODES", 30)
    rows = crowd(60, 12, 20_000) + crowd(60, 13, 30_000) + documents(8, 20)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()} == near_brute(rows, 5, 0.8)


def test_near_dedup_of_groups_whose_leaders_find_nothing(spark, monkeypatch):
    rows = crowd(60, 14)
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, vectors, threshold: pairs.limit(0))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()} == near_brute(rows, 5, 0.8)


def test_verification_is_by_weights():
    import numpy as np

    a = (np.array([1, 2, 3], np.uint64), np.array([1.0, 2.0, 1.0]))
    b = (np.array([2, 3, 9], np.uint64), np.array([1.0, 1.0, 1.0]))
    assert near_dedup.similarity(a, b) == 2 / 5


def test_components(spark):
    from factloom.llm.components import components

    links = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}
