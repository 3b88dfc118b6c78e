"""A data source for packed graph files and update logs.

Files are opened through pyarrow's file systems where they lie, and inflated in pieces: no cell and no
buffer holds a file. A packed stream can only be read from its start, so it is one partition; a log has
many streams, its blocks, which are found by one pass over each file that makes no rows, and then read
in parallel by their offsets.

``part`` says what is read: ``ids`` and ``edges`` (with ``weighted``) of packed vertex and edge files;
``properties``, ``vertices`` and ``blocks`` of logs. Writing takes updates and makes logs.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vertexloom.files import located
from vertexloom.operators.algebra import real_weight
from vertexloom.sources.binary import BINARY, EDGES_BEGIN, FILE_ROWS, FINAL_BEGIN, GIVEN, NUM_BLOCKS, TEMPORARY_BEGIN, _by_rows, _longs, _made, encode_log, parse_log_header

NAME = "packed_graph"
#: Bytes that are read and inflated at a time.
PIECE = 1 << 20
#: Where a writer tells which files belong to the log, and the header's key for the number of a file's first update.
MANIFEST, FIRST = "_files.json", "first"
SCHEMAS = {
    "ids": "id long",
    "edges": "src long, dst long, weight double",
    "properties": "file string, key string, value string",
    "vertices": "id long, temporary boolean",
    "blocks": "file string, number long, offset long, length long, updates long, first long, given boolean",
}


def listed(path: str) -> list[str]:
    """A file, or the files of a folder by name: those of its manifest, or all that are not hidden."""
    system, root = located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = {i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File}
    if MANIFEST in names:
        with system.open_input_file(f"{root}/{MANIFEST}") as f:
            names = set(json.loads(f.read()))
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if not n.startswith(("_", "."))]


def _inflated(f, record: int, wbits: int) -> Iterator[bytes]:
    """A stream from the file's place on, in pieces of whole records."""
    unpack, rest = zlib.decompressobj(wbits), b""
    while not unpack.eof:
        data = unpack.unconsumed_tail or f.read(PIECE)
        if not data:
            break
        rest += unpack.decompress(data, PIECE)
        whole = len(rest) // record * record
        if whole:
            yield rest[:whole]
            rest = rest[whole:]
    if rest or not unpack.eof:
        raise ValueError("the stream ends within a record")


def _header(f) -> tuple[dict[str, str], int]:
    """A log's properties and where its binary part starts; reads until the header ends."""
    head = b""
    while BINARY not in head or b"\n" not in head[head.index(BINARY) :]:
        data = f.read(4096)
        if not data:
            raise ValueError("no update log")
        head += data
    return parse_log_header(head)


def _blocks(f, file: str) -> Iterator[tuple]:
    """The blocks of a log, found by inflating them without keeping anything."""
    found, start = _header(f)
    at, first, number = int(found.get(EDGES_BEGIN, start)), int(found.get(FIRST, 0)), 0
    count, size = int(found.get(NUM_BLOCKS, -1)), f.size()
    while at < size and number != count:
        f.seek(at)
        unpack, n = zlib.decompressobj(-15), 0
        while not unpack.eof:
            data = unpack.unconsumed_tail or f.read(PIECE)
            if not data:
                raise ValueError("a block ends within a record")
            n += len(unpack.decompress(data, PIECE))
        end = f.tell() - len(unpack.unused_data)
        if n % 24:
            raise ValueError("a block ends within a record")
        yield file, number, at, end - at, n // 24, first, GIVEN in found
        at, first, number = end, first + n // 24, number + 1


@dataclass
class FilePartition(InputPartition):
    file: str


class PackedReader(DataSourceReader):
    """A partition per file."""

    def __init__(self, path: str, part: str, weighted: bool):
        self.path, self.part, self.weighted = path, part, weighted

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(file) for file in listed(self.path)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, path = located(partition.file)
        with system.open_input_file(path) as f:
            yield from getattr(self, f"_{self.part}")(f, partition.file)

    def _ids(self, f, file: str) -> Iterator[pa.RecordBatch]:
        for piece in _inflated(f, 8, zlib.MAX_WBITS):
            yield pa.RecordBatch.from_pydict({"id": pa.array(_longs(np.frombuffer(piece, "<u8")))})

    def _edges(self, f, file: str) -> Iterator[pa.RecordBatch]:
        fields = [("src", "<u8"), ("dst", "<u8")] + [("weight", "<f8")] * self.weighted
        for piece in _inflated(f, 24 if self.weighted else 16, zlib.MAX_WBITS):
            rows = np.frombuffer(piece, np.dtype(fields))
            weights = pa.array(rows["weight"].astype(float)) if self.weighted else pa.nulls(len(rows), pa.float64())
            yield pa.RecordBatch.from_pydict({"src": pa.array(_longs(rows["src"])), "dst": pa.array(_longs(rows["dst"])), "weight": weights})

    def _properties(self, f, file: str) -> Iterator[pa.RecordBatch]:
        found, _ = _header(f)
        yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(found), pa.string()), "key": pa.array(list(found), pa.string()), "value": pa.array(list(found.values()), pa.string())})

    def _vertices(self, f, file: str) -> Iterator[pa.RecordBatch]:
        found, _ = _header(f)
        for key, temporary in ((FINAL_BEGIN, False), (TEMPORARY_BEGIN, True)):
            if key in found:
                f.seek(int(found[key]))
                for piece in _inflated(f, 8, -15):
                    ids = _longs(np.frombuffer(piece, "<u8"))
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "temporary": pa.array(np.full(len(ids), temporary))})

    def _blocks(self, f, file: str) -> Iterator[tuple]:
        yield from _blocks(f, file)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class LogWriter(DataSourceArrowWriter):
    """Logs of at most ``rows`` updates each; the manifest names those of tasks that were committed."""

    def __init__(self, path: str, rows: int, block: int):
        self.path, self.rows, self.block = path, rows, block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        names = []
        for own in _by_rows((b.to_pandas() for b in iterator), self.rows):
            first = int(own["seq"].iloc[0])
            ids = np.unique(own[["src", "dst"]].to_numpy(np.int64))
            names.append(f"{first:020d}-{uuid.uuid4().hex}.graphlog")
            with system.open_output_stream(f"{root}/{names[-1]}") as f:
                f.write(encode_log({"updates": len(own), FIRST: first, GIVEN: 1}, ids, np.array([]), own, self.block))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.delete_file(f"{root}/{name}")


class PackedGraph(DataSource):
    """``spark.read.format("packed_graph").option("part", ...).load(path)``, and ``write`` for logs."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "blocks")]

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], self.options.get("part", "blocks"), self.options.get("weighted", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], int(self.options.get("rows", FILE_ROWS)), int(self.options.get("block", 4096)))


def _load(spark: SparkSession, path: str, part: str, **options) -> DataFrame:
    spark.dataSource.register(PackedGraph)
    return spark.read.format(NAME).options(part=part, **options).load(path)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(id)`` of packed vertex files."""
    return _load(spark, path, "ids")


def read_edges(spark: SparkSession, path: str, weighted: bool = True, max_weight: float = 1.0, seed: int = 97) -> DataFrame:
    """``(src, dst, weight)`` of packed edge files; weights are made if they have none."""
    edges = _load(spark, path, "edges", weighted=str(weighted).lower())
    return edges if weighted else edges.withColumn("weight", real_weight(seed, max_weight))


def log_properties(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, value)`` of logs' headers."""
    return _load(spark, path, "properties")


def log_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(id, temporary)``: the vertices that stay and those that are removed at the end."""
    return _load(spark, path, "vertices")


def log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Where each block of a log's files is, how many updates it has and the number of its first."""
    return _load(spark, path, "blocks")


def log_updates(spark: SparkSession, path: str, max_weight: float = 1.0, seed: int = 97) -> DataFrame:
    """``(seq, src, dst, weight)`` of logs, block by block in parallel.

    Numbers start from what a file's header says, else from 0; of several files without such headers they
    go on in the order of their names. -1 deletes; a weight of 0 is made, over 0 and up to ``max_weight``,
    unless the file's header says that weights are given.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, file = located(row["file"])
                with system.open_input_file(file) as f:
                    f.seek(row["offset"])
                    block = zlib.decompress(f.read(row["length"]), -15)
                n = row["updates"]
                ends, weights = np.frombuffer(block[: 16 * n], "<u8"), np.frombuffer(block[16 * n :], "<f8")
                first = row["first"]
                arrays = [np.arange(first, first + n), _longs(ends[:n]), _longs(ends[n:]), weights, np.full(n, row["given"])]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["seq", "src", "dst", "weight", "given"])

    blocks = log_blocks(spark, path)
    sizes = blocks.groupBy("file").agg(F.sum("updates").alias("n"), F.min("first").alias("from"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = sizes.select(F.col("file").alias("own"), F.when(F.max("from").over(Window.partitionBy()) == 0, F.coalesce(F.sum("n").over(before), F.lit(0))).otherwise(0).alias("offset_by"))
    placed = blocks.join(F.broadcast(starts), F.col("file") == F.col("own")).withColumn("first", F.col("first") + F.col("offset_by"))
    dealt = placed.select("file", "offset", "length", "updates", "first", "given").repartition(spark.sparkContext.defaultParallelism * 4, "file", "offset")
    return _made(dealt.mapInArrow(decode, "seq long, src long, dst long, weight double, given boolean"), max_weight, seed)


def write_log(log: DataFrame, path: str, rows: int = FILE_ROWS, block: int = 4096) -> None:
    """A log as files of ranges of ``seq``, of at most ``rows`` updates, without cells that hold one."""
    log.sparkSession.dataSource.register(PackedGraph)
    ranges = log.select("seq", "src", "dst", "weight").repartitionByRange("seq").sortWithinPartitions("seq")
    ranges.write.format(NAME).options(rows=rows, block=block).mode("append").save(path)


def write_packed(edges: DataFrame, path: str, weighted: bool = True) -> None:
    """Edges, or vertices of one column ``id``, as packed files: one for each partition."""
    root = path.rstrip("/")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, system, name = zlib.compressobj(), None, None
        names = [c for c in ("id", "src", "dst", "weight") if c in kinds]
        for frame in frames:
            if system is None:
                system, folder = located(root)
                system.create_dir(folder, recursive=True)
                name = f"part-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{folder}/{name}")
            rows = np.empty(len(frame), np.dtype([(c, "<f8" if c == "weight" else "<u8") for c in names]))
            for c in names:
                rows[c] = frame[c].to_numpy()
            out.write(packer.compress(rows.tobytes()))
        if system is not None:
            out.write(packer.flush())
            out.close()
            yield pd.DataFrame({"name": [name]})

    kinds = ["id"] if "id" in edges.columns else ["src", "dst"] + ["weight"] * weighted
    names = [r["name"] for r in edges.select(*kinds).mapInPandas(put, "name string").collect()]  # a row per partition
    system, folder = located(root)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{MANIFEST}") as f:
        f.write(json.dumps(sorted(names)).encode())
