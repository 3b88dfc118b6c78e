"""Best-two-fit packing of token pieces into sequences.

Pieces are dealt at random over shards of a bounded number of pieces, and every shard is packed by
itself: a bin is filled greedily with the largest piece that fits, again and again; then its smallest
piece is replaced by two unpacked ones if they fill the gap that it leaves more tightly. A shard can
waste part of a few bins, so the total is as good as that of one large packing up to these.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.session import cut, spread, table

MODEL = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 0
#: Pieces of one shard, about. A shard is one task's work; a bin or two of each stay part empty.
SHARD_PIECES = 8192
#: Segments that a worker remembers, and the longest of them. Both bound memory, not results.
REMEMBERED, LONGEST = 500_000, 40
#: What a space has beside it where a text can't be cut at every space; white space that is rare; the cut's own mark.
BESIDE, RARE = ("  ", " \n", "\n "), "\0\t\v\f\r\x1c\x1d\x1e\x1f"
ODD_SPACE = re.compile(r"[\x80-\U0010ffff](?<=\s)")


class _Memory(dict):
    """Ids by segment; a missing segment is encoded, and remembered if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, segment: str) -> bytes:
        found = self.encode(segment)
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = found
        return found


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer's library gives them.

    The tokenizer's pattern lets a token start with one space and otherwise never joins white space
    with what follows it, so a text can be cut before every space that has no white space on either
    side. Segments are encoded once and remembered. Short ones are encoded by a merger of byte ranks
    built from the same file, which gives the same ids with less work a call; long segments and texts
    with the string of an added token go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        names = _byte_names()
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.added}
        ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items()}
        self.merger = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lone = re.compile(r"(?<!\s) (?!\s)")
        self.known = _Memory(self._segment)

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _segment(self, segment: str) -> bytes:
        if len(segment) > LONGEST:
            return self.library([segment])[0] if segment else b""
        return array("I", self.merger.encode_ordinary(segment)).tobytes()

    def text(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.library([text])[0]
        if any(x in text for x in (*BESIDE, *RARE)) or not text.isascii() and ODD_SPACE.search(text):
            head, *tail = self.lone.split(text)
            parts = [head, *[" " + x for x in tail]]
        else:
            parts = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.known.__getitem__, parts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.text, texts))


@cache
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def tokenise(
    docs: DataFrame,
    model: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every document's ids.

    A document's ids are the tokenizer's without added tokens, then ``end_id``; only documents of
    over ``capacity`` ids are cut, and then the first piece takes what whole pieces leave over.
    """

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(model), np.asarray([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc_id, ids in zip(frame["doc_id"], encode(frame["text"].tolist()), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                stop = n % capacity or capacity
                piece = 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    row = (doc_id, piece, start, stop - start, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("i4")) if with_ids else row)
                    piece, start, stop = piece + 1, stop, stop + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInPandas(pieces, schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of every piece, for lengths of 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    held = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate(([0], np.cumsum(held)))[:-1]  # where a length's pieces start in order
    left = held.copy()
    sizes = np.arange(capacity + 1)
    fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest unpacked length up to each
    bins: list[list[int]] = []

    def emptied(size: int) -> None:
        """No piece of this length is left: the next smaller one takes its place."""
        stop = size + 1
        while stop <= capacity and fits[stop] == size:
            stop += 1
        fits[size:stop] = fits[size - 1]

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            emptied(size)

    def put_back(size: int) -> None:
        left[size] += 1
        if left[size] == 1:
            part = fits[size:]
            part[part < size] = size

    while fits[capacity]:
        room, mine = capacity, []
        while room and (size := int(fits[room])):
            take(size)
            mine.append(size)
            room -= size
        if room and fits[capacity] and len(mine) > 1:
            small = mine[-1]
            gap = room + small
            one = np.flatnonzero(left[1:gap] > 0) + 1
            if len(one):
                two = fits[gap - one]
                same = (two == one) & (left[one] < 2)  # the only piece of its length can't be both
                two = np.where(same, fits[np.minimum(gap - one, one - 1)], two)
                total = np.where(two > 0, one + two, 0)
                best = int(total.argmax())
                if total[best] > small:
                    a, b = int(one[best]), int(two[best])
                    take(a)
                    take(b)
                    mine[-1:] = [a, b]
                    put_back(small)
        bins.append(mine)
    which, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = first.copy()
    for k, mine in enumerate(bins):
        at = 0
        for size in mine:
            i = order[used[size]]
            used[size] += 1
            which[i], place[i] = k, at
            at += size
    return which, place


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the lengths must be 1 to ``capacity``.

    The number of shards follows the number of pieces, and pieces are dealt by a hash of the row and
    of its place in ``pieces``, so neither a source nor a group of copies, nor ids that are null or
    repeat, land in one shard. Places only stay as they are if ``pieces`` has been written before
    (``cut``). Sequences never span shards.
    """
    shards = max(1, round(pieces.count() / shard_pieces))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        which, place = best_two_fit(frame["length"].to_numpy(np.int64), capacity)
        frame["sequence_id"] = frame["shard"].to_numpy(np.int64) * (1 << 32) + which
        frame["offset"] = place
        return frame.drop(columns="shard")

    names = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packed, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, model: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of ``docs``.

    A null text counts as empty: one piece that holds the end id. Repeated rows are packed each for
    itself; an empty table gives no rows; other columns are not read.
    """
    return pack(cut(tokenise(docs, model, capacity)), capacity, shard_pieces)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(MODEL))
