"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A text's terms are its words and its four-byte grams, both hashed to a fixed number of terms, the
three-character shapes it is written in (character classes, not letters, so that they carry over between
languages) and how its words repeat. Damped term counts, weighted by rarity among all documents, are
projected on the leading singular vectors of a bounded sample of labelled documents. The sample's own
vectors are broadcast with their labels; every document's cosine with each of them is computed in
blocks, exactly, and the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.text import as_row, from_row
from vertexloom.session import cut, spread, table

#: Labelled documents that the model is made of, at most: those with the smallest hashes of their ids.
SAMPLE = 3000
#: Latent dimensions, voting neighbours, the power of the similarity that weights a vote, the threshold.
DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 48, 25, 8, 0.3
#: Documents whose cosines are computed at once.
BLOCK = 512

# Character classes by UTF-8 byte; what is listed nowhere is class 0.
CLASSES = (
    b"",
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\r\n",
    b".,;:?",
    b"!",
    b"'\"()-",
    b"|#*%&$<>{}[]=_/\\~^@+`",
    bytes(range(0x80, 0x100)),
)
_N = len(CLASSES)
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[list(_chars)] = _i
SHAPES = _N**3
#: After the shapes: words, words equal to the one before, distinct words, lines, distinct lines; then hashed words and grams.
HASHED, GRAM = 2048, 4
TERMS = SHAPES + 5 + 2 * HASHED
#: Weight of words and of grams beside the shapes.
HASHED_WEIGHT = 0.5


def term_counts(text: str | None) -> np.ndarray:
    """Damped shares of a text's terms; zeros for an empty text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    plain = text.encode()
    data = _CLASS[np.frombuffer(plain, np.uint8)]
    shapes = data[:-2] * (_N * _N) + data[1:-1] * _N + data[2:]
    out[:SHAPES] = np.bincount(shapes, minlength=SHAPES) / max(1, len(shapes))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[SHAPES : SHAPES + 5] = len(words) / len(data), sum(map(eq, words, words[1:])) / n, len(set(words)) / n, len(lines) / n, len(set(lines)) / len(lines)
    folded = plain.lower()
    keys = np.fromiter(map(crc32, folded.split()), np.int64) % HASHED
    raw = np.frombuffer(folded, np.uint8).astype(np.uint32)
    grams = raw[: 1 - GRAM] | (raw[1:-2] << 8) | (raw[2:-1] << 16) | (raw[3:] << 24) if len(raw) >= GRAM else raw[:0]
    grams = (grams * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) % HASHED
    for at, found in ((SHAPES + 5, keys), (SHAPES + 5 + HASHED, grams)):
        out[at : at + HASHED] = np.bincount(found, minlength=HASHED) * (HASHED_WEIGHT**2 / max(1, len(found)))
    return np.sqrt(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        vectors = (counts * self.weights) @ self.axes
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of the votes for label 1; the sample's share of it where nobody votes."""
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(texts) if k else 0, BLOCK):
            counts = np.stack([term_counts(t) for t in texts[start : start + BLOCK]])
            near = self.embed(counts) @ self.vectors.T
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            votes = np.clip(np.take_along_axis(near, top, 1), 0, 1).astype(np.float64) ** SHARPNESS
            total = votes.sum(axis=1)
            share = (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-300)
            out[start : start + BLOCK] = np.where((total > 1e-6) & counts.any(axis=1), share, self.prior)
        return np.clip(out, 0.0, 1.0)


def leading_axes(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """The ``k`` leading right singular vectors of a matrix, by subspace iteration from a fixed start."""
    width = min(k + 16, *rows.shape)
    basis = np.random.default_rng(1).standard_normal((rows.shape[0], width)).astype(rows.dtype)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ basis)
        basis = rows @ basis
    basis, _ = np.linalg.qr(rows.T @ basis)
    return basis @ np.linalg.svd(rows @ basis, full_matrices=False)[2][:k].T


def fit(counts: np.ndarray, labels: np.ndarray, seen: np.ndarray | None = None, n_docs: int = 0) -> Model:
    """Model of a labelled sample; with no rows every score is one half.

    ``seen``: how many of ``n_docs`` documents have each term; without it the sample's own counts stand for it.
    """
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    if seen is None:
        seen, n_docs = (counts > 0).sum(axis=0), len(labels)
    weights = np.where(seen, np.log((1 + n_docs) / (1 + seen)) + 1, 0).astype(np.float32)
    terms = np.flatnonzero((counts > 0).any(axis=0) & (weights > 0))
    axes = np.zeros((TERMS, min(DIMENSIONS, max(1, len(terms)), len(labels))), np.float32)
    if len(terms):
        axes[terms] = leading_axes((counts * weights)[:, terms], axes.shape[1])
    bare = Model(weights, axes, np.zeros((0, 1), np.float32), labels, 0.5)
    return Model(weights, axes, bare.embed(counts), labels.astype(np.float64), float(labels.mean()))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are; a row per term comes to the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                seen += term_counts(text) > 0
            n += len(frame)
        own = np.append(seen, n)
        yield pd.DataFrame({"term": np.flatnonzero(own), "n": own[own > 0]})

    found = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(TERMS + 1, np.int64)
    for row in found:
        seen[row["term"]] = row["n"]
    return seen[:-1], int(seen[-1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: a fifth of all, by a checksum of its id."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out.

    Rows without a quality do not count; where an id has several labels the lowest holds. How rare a
    term is, is counted over all documents. Only the sample's non-zero term counts and a row per term
    come to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [term_counts(t) for t in frame["text"]]
            terms = [np.flatnonzero(r).astype("<u2") for r in rows]
            values = [r[t].tobytes() for r, t in zip(rows, terms)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "terms": [t.tobytes() for t in terms], "counts": values})

    counted = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInPandas(
        count, "doc_id long, quality int, terms binary, counts binary"
    )
    got = counted.orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts").limit(sample).collect()
    if not got:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0, np.int64))
    counts = np.zeros((len(got), TERMS), np.float32)
    for own, row in zip(counts, got):
        own[np.frombuffer(row["terms"], "<u2")] = np.frombuffer(row["counts"], np.float32)
    return fit(counts, np.asarray([r["quality"] for r in got], np.int64), *document_frequencies(docs))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and a score from 0 to 1 of the column ``text``; higher: label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(name, score("text"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    docs has ``doc_id`` and ``text``, labels ``doc_id`` and ``quality``; other columns are not read
    and ids are no input of a score. Empty and null texts get the sample's share of label 1, and so
    does every text if nothing is labelled: one half. Repeated rows get equal scores; an empty table
    gives no rows.
    """
    model = train(docs, labels, sample)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever these are called.

    Null and empty texts are scored as texts without terms; very long ones are read whole. Repeated rows
    and null ids are judged each for itself and stay or go together; an empty table gives no rows.
    """
    rows = docs.select(as_row(docs).alias("row"), "text")
    return from_row(with_score(rows, train(docs, labels)).where(F.col("score") >= THRESHOLD), docs)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
