"""Exact dedup by content-defined chunk recipes.

A text is cut where a hash of the eight bytes before a place hits a pattern, so equal passages give
equal chunks wherever they stand. A chunk's identifier is its SHA-256, and a text's recipe is the
ordered list of its identifiers, 32 bytes for some four thousand of text. Equal texts are those with
equal recipes. Identifiers are counted from the recipes; those used more than once are verified by
comparing the bytes of their chunks, and the bytes of a chunk that occurs once are compared with none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.text import as_row, from_row, lower_ascii
from vertexloom.session import cut, spread, table

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 1024, 16384, 12
#: Bytes of an identifier.
DIGEST = 32


def chunk_ends(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ``data``; none for empty bytes. A chunk has ``most`` bytes at most."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    word = np.frombuffer(data, np.uint8).astype(np.uint64)
    for shift in (1, 2, 4):  # word[i] holds the eight bytes from i on
        word = word[:-shift] | (word[shift:] << np.uint64(8 * shift))
    hit = (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - mask_bits) == 0
    ends, last = [], 0
    for end in (np.flatnonzero(hit) + 8).tolist():
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least:
            last = end
            ends.append(last)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _normal(text: str | None) -> bytes:
    """Text as bytes with A-Z lower-cased; bytes.lower() leaves all bytes over 127 alone."""
    return b"" if text is None else text.encode().lower()


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each identifier with its bytes, once for the texts that are cut together."""

    def table(held: set[tuple[bytes, bytes]]) -> pd.DataFrame:
        return pd.DataFrame(list(held), columns=["chunk", "body"])

    for frame in frames:
        held, size = set(), 0
        for text in frame["text"]:
            data, start = _normal(text), 0
            for end in chunk_ends(data):
                body, start = data[start:end], end
                held.add((hashlib.sha256(body).digest(), body))
                size += len(body)
            if size > 8 << 20:
                yield table(held)
                held, size = set(), 0
        yield table(held)


def _recipes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        recipes, hashes = [], []
        for text in frame["text"]:
            data, start, parts = _normal(text), 0, []
            for end in chunk_ends(data):
                parts.append(hashlib.sha256(data[start:end]).digest())
                start = end
            recipes.append(b"".join(parts))
            hashes.append(hashlib.sha256(data).hexdigest())
        yield pd.DataFrame({"doc_id": frame["doc_id"], "text_sha256": hashes, "recipe": recipes})


def chunk_uses(recipes: DataFrame) -> DataFrame:
    """``(chunk, n_uses)``: how often each identifier is used by the rows of ``(recipe, copies)``."""
    places = F.sequence(F.lit(1), F.octet_length("recipe"), F.lit(DIGEST))
    chunks = recipes.where(F.octet_length("recipe") > 0).select("recipe", "copies", F.explode(places).alias("at"))
    return chunks.groupBy(F.substring("recipe", F.col("at"), F.lit(DIGEST)).alias("chunk")).agg(F.sum("copies").alias("n_uses"))


def chunk_store(docs: DataFrame, chosen: DataFrame, text_col: str = "text") -> DataFrame:
    """``(chunk, n_bytes, verified)`` of each identifier in ``chosen``; verified if all its bodies are one."""
    chunks = docs.select(F.col(text_col).alias("text")).mapInPandas(_chunks, "chunk binary, body binary")
    return (
        chunks.join(chosen.select("chunk"), "chunk", "left_semi")
        .groupBy("chunk")
        .agg(F.max(F.octet_length("body")).alias("n_bytes"), (F.min("body") == F.max("body")).alias("verified"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, copies)`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty and all empty texts
    are one group. Of a group the row with the largest doc_id stays. Rows that repeat both doc_id
    and text all come back, one of them as kept. Null ids count as smaller than all others. Other
    columns are not read. Two chunks of one identifier with different bytes stop the job.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    recipes = rows.mapInPandas(_recipes, "doc_id long, text_sha256 string, recipe binary")
    recipes = cut(recipes.groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies")))
    repeated = chunk_uses(recipes).where("n_uses > 1")
    if chunk_store(docs, repeated, text_col).where(~F.col("verified")).limit(1).count():
        raise RuntimeError("two different chunks have the same SHA-256")
    groups = cut(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    return (
        recipes.join(groups, "recipe")
        .select("*", F.posexplode(F.sequence(F.lit(1), F.col("copies"))).alias("copy", "_"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
            "text_sha256",
            "copies",
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    ``docs`` has ``doc_id`` and ``text``. Rows that repeat both are one row in the result; of those
    that repeat the id alone each text is judged for itself. A null id stays if its group has no other.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("keep_sha"))
    sha = F.sha2(F.encode(lower_ascii(F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    named = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    stay = named.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["id", "sha"])
    return from_row(stay, docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(spread(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""
