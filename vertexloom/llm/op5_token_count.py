"""Token counts by byte-pair merging over a heap and a linked list.

A segment starts as one symbol per character. The heap holds adjacent pairs whose joint text is a
piece; the best pair is popped, its right symbol is taken out of the list and the pairs with the new
neighbours are pushed. The count is the initial symbols minus the merges; no identifiers are made. A
character that is no piece counts its UTF-8 bytes and never merges.

No piece has a word mark behind another character, so the parts of a text that start with word marks
cannot merge with one another, nor can characters that stand side by side in no piece. Both hold for
every text and let counts of parts be remembered and added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import spread, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Parts that a worker remembers, and the longest of them. Both bound memory, not results.
REMEMBERED, LONGEST = 800_000, 48


class _Memory(dict):
    """Counts by part; a missing part is counted, and remembered if it is short."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, part: str) -> int:
        found = self.count(part)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = found
        return found


class PieceCounter:
    """Counts tokens as the model's library does, without begin or end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a  b ", out_type=str)[:1] != [MARK + "a"]:
            raise ValueError(f"{path}: only models that keep white space and mark the start are supported")
        self.rank: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.rank[model.id_to_piece(i)] = int(-model.get_score(i))
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError(f"{path}: a piece has a word mark behind another character")
        self.single = {p for p in self.rank if len(p) == 1}
        self.beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.words = _Memory(lambda word: self.parts(MARK + word))
        self.runs = _Memory(self.merged)

    def merged(self, part: str) -> int:
        """Tokens of a part by merging."""
        rank, n = self.rank, len(part)
        if n == 1:
            return 1 if part in rank else len(part.encode())
        symbols, right, left = list(part), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := part[i : i + 2]) in rank]
        heapify(heap)
        merges = 0
        while heap:
            _, i, joint = heappop(heap)
            j = right[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != joint:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joint, ""
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (p := joint + symbols[after]) in rank:
                    heappush(heap, (rank[p], i, p))
            if (before := left[i]) >= 0 and (p := symbols[before] + joint) in rank:
                heappush(heap, (rank[p], before, p))
            merges += 1
        if not self.single.issuperset(part):
            n += sum(len(c.encode()) - 1 for c in part if c not in rank)
        return n - merges

    def parts(self, segment: str) -> int:
        """Tokens of a segment, cut between characters that no piece has side by side."""
        beside, runs, start, total = self.beside, self.runs, 0, 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in beside:
                total += runs[segment[start:i]]
                start = i
        return total + runs[segment[start:]]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.words.__getitem__, text.split(" ")))
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.parts, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)))


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(
    docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``model`` is the path of a sentencepiece BPE model that every executor can read. Null texts count
    as empty: no bytes, no tokens. Repeated rows stay, null ids too; other columns are not read.
    """

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model)
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"],
                "n_bytes": frame["n_bytes"],
                "n_tokens": [count(text) for text in frame["text"]],
            })

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInPandas(counts, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(MODEL))
