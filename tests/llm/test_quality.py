"""Quality scores on held-out labels, odd rows, and the votes against a plain computation."""

import zlib

import numpy as np
import pytest

from vertexloom.llm import op6_quality as op6

DOCS = "doc_id long, text string, row string, score string, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in op6.op6_quality(spark, path).collect()}
    assert len(found) == 10_000
    for r in found.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if found[r.doc_id].held_out]
    right = [found[r.doc_id].predicted == r.quality for r in labels]
    assert len(labels) > 500 and np.mean(right) > 0.98
    good = [found[r.doc_id].score for r in labels if r.quality]
    bad = [found[r.doc_id].score for r in labels if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_votes_are_those_of_the_nearest(spark):
    rng = np.random.default_rng(1)
    counts = rng.random((60, op6.TERMS), np.float32)
    model = op6.fit(counts, (np.arange(60) % 3 > 0).astype(int))
    text = "some Text here!! | 12"
    own = model.embed(op6.term_counts(text)[None])[0]
    cosines = model.vectors @ own
    top = sorted(range(60), key=lambda i: -cosines[i])[: op6.NEIGHBOURS]
    votes = np.clip(cosines[top], 0, 1).astype(float) ** op6.SHARPNESS
    expected = (votes * model.labels[top]).sum() / votes.sum()
    assert model.scores([text] * (op6.BLOCK + 3)) == pytest.approx(expected, abs=1e-5)


def test_axes_are_those_of_a_plain_decomposition():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((90, 20)) * 0.8 ** np.arange(20)) @ rng.standard_normal((20, 300)) + 0.01 * rng.standard_normal((90, 300))
    axes = op6.leading_axes(rows, 10)
    plain = np.linalg.svd(rows, full_matrices=False)[2][:10].T
    assert np.allclose(axes.T @ axes, np.eye(10), atol=1e-6)
    assert np.linalg.svd(plain.T @ axes)[1].min() > 0.999


def test_words_alone_can_tell(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"g{'abcdefgh'[i]}x" for i in range(8)], [f"b{'abcdefgh'[i]}x" for i in range(8)]
    texts = [" ".join(rng.choice(bad if i % 3 == 0 else good, 30)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "") for i in range(400)], LABELS)
    found = [r for r in op6.classify(docs, labels).collect() if r.held_out]
    assert len(found) > 50 and all(r.predicted == int(r.doc_id % 3 > 0) for r in found)


def test_frequencies_count_all_documents(spark):
    texts = ["one two", "two", None, "", "two | three !!"] * 7
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS).repartition(3)
    seen, n = op6.document_frequencies(docs)
    assert n == 35 and (seen == sum((op6.term_counts(t) > 0).astype(int) for t in texts)).all()


def test_odd_rows(spark):
    rows = [(1, None, "x", "y", "z"), (1, None, "x", "y", "z"), (2, "", "", "", ""), (None, "a", "", "", ""), (3, "ab " * 60_000, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    for labels in ([], [(1, 1, 0, "t"), (3, 0, 1, "t"), (3, 1, 1, "t"), (4, None, 0, "t"), (None, 1, 0, "t")]):
        frame = spark.createDataFrame(labels, LABELS)
        found = op6.classify(docs, frame).collect()
        assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "3", "None"]
        assert all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
        kept = op6.keep_good(docs, frame)
        assert kept.columns == docs.columns
    assert op6.classify(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
