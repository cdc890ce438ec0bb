import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import simple8b
from factloom.llm.common import shared_dir
from factloom.llm.token_files import read_token_files, token_digests, write_token_files
from tests.llm.data import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()
    assert len(offsets) == -(-len(v) // simple8b.BLOCK)


ODD = [(1, "It's <|endoftext|> a\u0301b É..., ÉCOLE!? x1y2 'tis don't—so"), (1, "same id"), (7, "\u0130stanbul ß\u00a0x\u2003y \u3000"), (3, "İ ſ µ ª ŉ Ǆ, ﬁ"), (None, "no id")]


def test_files_hold_what_the_library_gives(spark):
    rows = documents() + ODD
    path = shared_dir(spark)
    write_token_files(frame(spark, rows).selectExpr("*", "1 as shard", "2 as words"), path, PATH)
    got = [tuple(r) for r in token_digests(spark, path).orderBy("start").collect()]
    library, expected, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    whole = {r.start: r.ids for r in read_token_files(spark, path).collect()}
    assert all(zlib.crc32(np.array(whole[s], "<u4").tobytes()) == c for _, s, _, c in expected)


def test_an_empty_table(spark):
    path = shared_dir(spark)
    write_token_files(frame(spark, []), path, PATH)
    assert token_digests(spark, path).count() == 0
    assert pytest.approx(0) == read_token_files(spark, path).count()
