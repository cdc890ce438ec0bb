import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from factloom.llm.sentencepiece_viterbi import Automaton, decode, encode, model
from tests.llm.data import documents, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁a ▁", " ", "  x\n\n y", "é ﬁ 漢字 😀\u0000\t", "a" * 5000, "x▁▁ y   z"]


def test_round_trip_and_columns(spark):
    rows = documents() + [(3000 + k, t) for k, t in enumerate(ODD)]
    df = frame(spark, rows).withColumn("ids", F.lit("old")).withColumn("extra", F.lit(1))
    coded = encode(df, PATH)
    assert coded.columns == ["doc_id", "text", "extra", "ids"]
    for r in decode(coded, PATH, out="back").collect():
        assert r.back == (r.text or "") and r.extra == 1
    assert encode(df.limit(0), PATH).count() == 0


def test_the_best_score_by_brute_force():
    m, r = model(PATH), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    score = {library.id_to_piece(k): library.get_score(k) for k in range(library.get_piece_size()) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))}
    for _ in range(150):
        text = "▁" + "".join(r.choice("abcdehinorst漢") for _ in range(r.randint(1, 9)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = best[i - 1] + m.unknown
            for j in range(max(0, i - 16), i):
                if text[j:i] in score:
                    best[i] = max(best[i], best[j] + score[text[j:i]])
        got, ids, k = 0.0, m.segment(text), 0
        while k < len(ids):
            if library.is_byte(ids[k]):
                got, k = got + m.unknown, k + 3
            else:
                got, k = got + score[library.id_to_piece(ids[k])], k + 1
        assert abs(got - best[-1]) < 1e-6


def test_encoding_in_stretches_is_encoding_whole_texts():
    m, r = model(PATH), random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(["the", "er", " ", "  ", "\n", "né", "x", "漢", "ing", "Zu", ".", "12"]) for _ in range(r.randint(1, 40)))
        assert m.encode(text) == np.array(m.segment("▁" + text.replace(" ", "▁")), np.int32).tobytes()


def test_bad_ids_and_a_full_automaton(spark, monkeypatch):
    m = model(PATH)
    hello = m.encode("hello there")
    rows = [(1, hello), (2, hello + np.array([-1, 32_000, 2**31 - 1], np.int32).tobytes()), (3, hello + b"xy"), (4, None), (5, np.array([99_999], np.int32).tobytes())]
    got = {r.k: r.text for r in decode(spark.createDataFrame(rows, "k int, ids binary"), PATH).collect()}
    assert got == {1: "hello there", 2: "hello there\ufffd\ufffd\ufffd", 3: "hello there", 4: "", 5: "\ufffd"}
    monkeypatch.setattr("factloom.llm.sentencepiece_viterbi.LEARNT", 0)
    new = type(m)(PATH)
    assert new.encode("unlearnt transitions, anew") == m.encode("unlearnt transitions, anew") and new.learnt == 0


def test_output_links_find_every_piece():
    a = Automaton([(p, k, 0.0) for k, p in enumerate(["he", "she", "his", "hers", "e"])])
    found, s = [], 0
    for i, c in enumerate("ushers", 1):
        while s and c not in a.next[s]:
            s = a.fail[s]
        s = a.next[s].get(c, 0)
        o = s if a.own[s] else a.output[s]
        while o:
            found.append((i, a.own[o][1]))
            o = a.output[o]
    assert found == [(4, 1), (4, 0), (4, 4), (6, 3)]
    assert np.array(found).shape == (4, 2)
