"""Binary formats: zlib-packed LDBC files and update logs.

A packed stream can only be read from its start, so a file is one task; it is unpacked in pieces. The
``unpack_`` functions take files as a DataFrame with ``content``, as Spark's ``binaryFile`` reads them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.algebra import real_weight

# What a log starts with, and what ends its header.
MAGIC, BINARY = b"# GRAPHLOG", b"__BINARY_SECTION_FOLLOWS"
# Keys of a log's header, where its parts begin and how its blocks are.
FINAL_BEGIN, TEMPORARY_BEGIN = "internal.vertices.final.begin", "internal.vertices.temporary.begin"
EDGES_BEGIN, NUM_BLOCKS, BLOCK_SIZE = "internal.edges.begin", "internal.edges.num_blocks", "internal.edges.block_size"
# A header's key: whether weights of 0 are weights. Logs of others lack it, and there 0 means that a weight is to be made.
GIVEN = "weights.given"
_PIECE = 1 << 22
#: Rows of a file that is written, at most; a cell holds a file.
FILE_ROWS = 1 << 18


def _longs(values: np.ndarray) -> np.ndarray:
    if values.size and int(values.max()) >= 1 << 63:
        raise OverflowError("an id is over 2^63 - 1")
    return values.astype(np.int64)


def _inflated(content: bytes, record: int, wbits: int = zlib.MAX_WBITS) -> Iterator[bytes]:
    """A stream's bytes in pieces of whole records, so that the unpacked file is never in memory at once."""
    unpack, rest = zlib.decompressobj(wbits), b""
    data = content
    while data and not unpack.eof:
        rest += unpack.decompress(data, _PIECE)
        data = unpack.unconsumed_tail
        whole = len(rest) // record * record
        if whole:
            yield rest[:whole]
            rest = rest[whole:]
    rest += unpack.flush()
    if len(rest) % record or not unpack.eof:
        raise ValueError("the stream ends within a record")
    if rest:
        yield rest


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def unpack_vertices(packed: DataFrame) -> DataFrame:
    """``(id)`` of a packed vertex file: little-endian unsigned longs."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for piece in _inflated(content, 8):
                    yield pd.DataFrame({"id": _longs(np.frombuffer(piece, "<u8"))})

    return packed.select("content").mapInPandas(decode, "id long")


def unpack_edges(packed: DataFrame, weighted: bool = True, max_weight: float = 1.0, seed: int = 97) -> DataFrame:
    """``(src, dst, weight)`` of a packed edge file; weights are made if it has none."""
    fields = [("src", "<u8"), ("dst", "<u8")] + [("weight", "<f8")] * weighted

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for piece in _inflated(content, 24 if weighted else 16):
                    rows = np.frombuffer(piece, np.dtype(fields))
                    out = {"src": _longs(rows["src"]), "dst": _longs(rows["dst"])}
                    yield pd.DataFrame(out | ({"weight": rows["weight"].astype(float)} if weighted else {}))

    edges = packed.select("content").mapInPandas(decode, "src long, dst long" + ", weight double" * weighted)
    return edges if weighted else edges.withColumn("weight", real_weight(seed, max_weight))


def parse_log_header(content: bytes) -> tuple[dict[str, str], int]:
    """A log's properties and where its binary part starts."""
    if not content.startswith(MAGIC):
        raise ValueError("no update log")
    at = content.index(BINARY)
    start = content.index(b"\n", at) + 1
    found = {}
    for line in content[:at].decode().split("\n"):
        if m := re.fullmatch(r"\s*([^\s=#]+)\s*=\s*([^#]*?)\s*", line):
            found[m[1]] = m[2]
    return found, start


def log_properties(packed: DataFrame) -> DataFrame:
    """``(key, value)`` of a log's header."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                found, _ = parse_log_header(content)
                yield pd.DataFrame({"key": list(found), "value": list(found.values())})

    return packed.select("content").mapInPandas(decode, "key string, value string")


# Keys of a log's header that tell what is left at its end.
FINAL_VERTICES, FINAL_EDGES = "internal.vertices.final.cardinality", "internal.edges.final"


def final_sizes(properties: DataFrame) -> dict[str, int]:
    """``vertices`` and ``edges`` that are left at a log's end, as far as its header tells; over all its files."""
    kinds = {FINAL_VERTICES: "vertices", FINAL_EDGES: "edges"}
    told = properties.where(F.col("key").isin(list(kinds))).groupBy("key").agg(F.sum(F.col("value").cast("long")).alias("n"))
    return {kinds[r["key"]]: r["n"] for r in told.collect()}


def log_vertices(packed: DataFrame) -> DataFrame:
    """``(id, temporary)``: the vertices that stay and those that are removed at the end."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                found, _ = parse_log_header(content)
                for key, temporary in ((FINAL_BEGIN, False), (TEMPORARY_BEGIN, True)):
                    if key in found:
                        for piece in _inflated(content[int(found[key]) :], 8, -15):
                            yield pd.DataFrame({"id": _longs(np.frombuffer(piece, "<u8")), "temporary": temporary})

    return packed.select("content").mapInPandas(decode, "id long, temporary boolean")


def log_updates(packed: DataFrame, max_weight: float = 1.0, seed: int = 97) -> DataFrame:
    """``(seq, src, dst, weight)`` in the log's order.

    ``packed`` may be several files of one log: with a column ``first`` (see ``pack_log``) a file's
    numbers start there, otherwise each file is a log of its own and starts from 0. A block is a raw deflate stream of sources, destinations and weights. -1 deletes; a weight of 0
    is made, over 0 and up to ``max_weight``, unless the header says that weights are given.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            firsts = frame["first"] if "first" in frame else [0] * len(frame)
            for content, first in zip(frame["content"], firsts):
                found, start = parse_log_header(content)
                at, seq = int(found.get(EDGES_BEGIN, start)), int(first)
                blocks = int(found.get(NUM_BLOCKS, -1))
                while at < len(content) and blocks != 0:
                    blocks -= 1
                    unpack = zlib.decompressobj(-15)
                    block = unpack.decompress(memoryview(content)[at:]) + unpack.flush()
                    at = len(content) - len(unpack.unused_data)
                    n, odd = divmod(len(block), 24)
                    if odd or not unpack.eof:
                        raise ValueError("a block ends within a record")
                    ends, weights = np.frombuffer(block[: 16 * n], "<u8"), np.frombuffer(block[16 * n :], "<f8")
                    yield pd.DataFrame({"seq": np.arange(seq, seq + n), "src": _longs(ends[:n]), "dst": _longs(ends[n:]), "weight": weights, "given": GIVEN in found})
                    seq += n

    own = packed.select("first", "content") if "first" in packed.columns else packed.select("content")
    return _made(own.mapInPandas(decode, "seq long, src long, dst long, weight double, given boolean"), max_weight, seed)


def _made(log: DataFrame, max_weight: float, seed: int) -> DataFrame:
    """A log with weights in place of each 0 that is not ``given``."""
    made = F.when((F.col("weight") == 0) & ~F.col("given"), real_weight(seed, max_weight)).otherwise(F.col("weight"))
    return log.withColumn("weight", made).drop("given")


def _by_rows(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in their order, so many at a time; only these are in memory."""
    held, n = [], 0
    for frame in frames:
        while len(frame):
            part, frame = frame.iloc[: rows - n], frame.iloc[rows - n :]
            held.append(part)
            n += len(part)
            if n == rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pack_edges(edges: DataFrame, weighted: bool = True, file_rows: int = FILE_ROWS) -> DataFrame:
    """``(content)``: packed edge files of at most ``file_rows`` edges; none without edges."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [("src", "<u8"), ("dst", "<u8")] + [("weight", "<f8")] * weighted
        for own in _by_rows(frames, file_rows):
            rows = np.empty(len(own), np.dtype(fields))
            for name, _ in fields:
                rows[name] = own[name].to_numpy()
            yield pd.DataFrame({"content": [zlib.compress(rows.tobytes())]})

    return edges.mapInPandas(encode, "content binary")


def _deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush()


def encode_log(properties: dict, final: np.ndarray, temporary: np.ndarray, updates: pd.DataFrame, block: int) -> bytes:
    """An update log's bytes: header, both vertex sections, blocks of ``block`` updates."""
    sections = [_deflate(np.asarray(v, "<u8").tobytes()) for v in (final, temporary)]
    blocks = []
    for at in range(0, len(updates), block):
        part = updates.iloc[at : at + block]
        blocks.append(_deflate(b"".join([part["src"].to_numpy("<u8").tobytes(), part["dst"].to_numpy("<u8").tobytes(), part["weight"].to_numpy("<f8").tobytes()])))
    start = 0
    for _ in range(3):  # the offsets are in the header and change its length
        places = {
            FINAL_BEGIN: start,
            TEMPORARY_BEGIN: start + len(sections[0]),
            EDGES_BEGIN: start + len(sections[0]) + len(sections[1]),
            NUM_BLOCKS: len(blocks),
            BLOCK_SIZE: 24 * block,
        }
        lines = [MAGIC.decode(), *[f"{k} = {v}" for k, v in (properties | places).items()], BINARY.decode(), ""]
        head = "\n".join(lines).encode()
        start = len(head)
    return b"".join([head, *sections, *blocks])


def pack_log(log: DataFrame, keys: list[str], block: int = 4096, file_rows: int = FILE_ROWS) -> DataFrame:
    """``(first, content)``: logs of at most ``file_rows`` updates; all their vertices are final.

    Each has a range of ``seq``, from ``first`` on, in order: read by ``first`` they are the whole log.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _by_rows(frames, file_rows):
            ids = np.unique(own[["src", "dst"]].to_numpy(np.int64))
            yield pd.DataFrame({"first": own["seq"].iloc[:1], "content": [encode_log({k: len(own) for k in keys} | {GIVEN: 1}, ids, np.array([]), own, block)]})

    ranges = log.select("seq", "src", "dst", "weight").repartitionByRange("seq").sortWithinPartitions("seq")
    return ranges.mapInPandas(encode, "first long, content binary")
