"""Token counts and packing against the tokenizers' own libraries."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from vertexloom.llm import op5_token_count as op5  # noqa: E402
from vertexloom.llm import op10_packing as op10  # noqa: E402

PIECES, BYTES = public_tokenizers.path(op5.MODEL), public_tokenizers.path(op10.MODEL)
SCHEMA = "doc_id long, text string, n_tokens string, shard string"
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "▁a ▁ b", "a▁", "<s> x </s>", "<|endoftext|>", "a <|endoftext|> b",
    "x\n\ny\t z", "don't  we'll　they've", "é é ﬁ \xa0 ½ 漢字 😀", "a\0b", "\x85x  y", "#" * 70, "ab" * 3000,
    "tail \n", "\n head", "' 's 't", "12 345 6", "a\x1c b \x1cc",
]
texts = st.text(st.sampled_from("aeth. ,'!#\n\t▁é<s>|漢0\0") | st.characters(codec="utf-8"), max_size=60)


@pytest.fixture(scope="module")
def pieces_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_count_as_the_library_does(pieces_model, text):
    assert op5.counter(PIECES)(text) == len(pieces_model.encode(text))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_any_text_counts_as_the_library_does(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert op5.counter(PIECES)(text) == len(model.encode(text))


def test_ids_are_the_library_s():
    encode = op10.encoder(BYTES)
    assert encode(ODD) == encode.library(ODD)
    rng = random.Random(3)
    for _ in range(300):
        some = ["".join(rng.choices("ab '’s\n\t.é!1　\x1c", k=rng.randrange(30))) for _ in range(20)]
        assert encode(some) == encode.library(some)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=5))
def test_any_ids_are_the_library_s(some):
    encode = op10.encoder(BYTES)
    assert encode(some) == encode.library(some)


def test_counts_over_a_table(spark):
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (2, "", None, None), (None, "a b", "x", "y"), (3, "word " * 5000, "", "")]
    found = op5.count_tokens(spark.createDataFrame(rows, SCHEMA), PIECES).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), (3, 25000, 5001, True)], key=str
    )
    assert op5.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def check_bins(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_are_gapless_and_few(lengths):
    which, place = op10.best_two_fit(np.asarray(lengths, np.int64), 64)
    at = {}
    for k, p, n in sorted(zip(which.tolist(), place.tolist(), lengths)):
        assert p == at.get(k, 0)
        at[k] = p + n
    assert all(n <= 64 for n in at.values())
    assert sorted(at) == list(range(len(at)))
    assert len(at) <= 2 * -(-sum(lengths) // 64) + 1


def test_two_pieces_replace_one():
    """Greedy gives 6 + 3 and leaves 2 + 2 + 1; with 2 + 2 in place of 3 the first bin is full."""
    which, _ = op10.best_two_fit(np.asarray([6, 3, 2, 2, 1]), 10)
    sizes = {k: sorted(n for w, n in zip(which, [6, 3, 2, 2, 1]) if w == k) for k in set(which.tolist())}
    assert max(map(sum, sizes.values())) == 10


def test_packing_of_odd_documents(spark):
    rows = [(1, None, "x", "y"), (2, "", "", ""), (3, "word " * 5000, "", ""), (3, "word " * 5000, "", ""), (None, "a", "", "")]
    found = op10.pack_documents(spark.createDataFrame(rows, SCHEMA), BYTES).collect()
    check_bins(found, 2048)
    assert sorted((r.piece, r.start, r.length) for r in found if r.doc_id == 1) == [(0, 0, 1)]
    own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found if r.doc_id == 3)
    ids = op10.encoder(BYTES).library(["word " * 5000])[0] + bytes(4)
    n = len(ids) // 4
    assert [x[2] for x in own] == sorted([n % 2048, n % 2048] + [2048] * (2 * (n // 2048)))
    for _, start, length, crc in own:
        assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
    assert op10.pack_documents(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_whole_table_is_packed_tightly(spark):
    path = "/root/testdata/sf0.01"
    found = op10.op10_packing(spark, path).collect()
    n = check_bins(found, 2048)
    assert n <= -(-sum(r.length for r in found) // 2048) * 1.01 + 1
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    ids = dict(zip(texts, op10.encoder(BYTES).library(list(texts.values()))))
    seen = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        part = (ids[r.doc_id] + bytes(4))[4 * r.start : 4 * (r.start + r.length)]
        assert r.start == seen.get(r.doc_id, 0) and zlib.crc32(part) == r.ids_crc32
        seen[r.doc_id] = r.start + r.length
    assert {d: len(x) // 4 + 1 for d, x in ids.items()} == seen
