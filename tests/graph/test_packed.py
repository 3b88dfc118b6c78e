"""The data source for packed files and logs."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vertexloom import files
from vertexloom.sources import binary, load, packed

LOG = "seq long, src long, dst long, weight double"


def log_of(n):
    return [(i, i % 17, 20 + i % 13, -1.0 if i % 5 == 0 else i / 4) for i in range(n)]


def test_a_log_of_several_blocks_is_read_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 50)
    rows = log_of(500)
    frame = pd.DataFrame(rows, columns=["seq", "src", "dst", "weight"])
    content = binary.encode_log({"name": "x"}, np.arange(40), np.array([50, 51]), frame, 30)
    (tmp_path / "one.graphlog").write_bytes(content)
    path = f"{tmp_path}/one.graphlog"
    blocks = packed.log_blocks(spark, path).orderBy("number").collect()
    assert [b.updates for b in blocks] == [30] * 16 + [20] and [b["first"] for b in blocks] == list(range(0, 500, 30))
    assert all(a.offset + a.length == b.offset for a, b in zip(blocks, blocks[1:])) and blocks[-1].offset + blocks[-1].length == len(content)
    updates = packed.log_updates(spark, path)
    assert sorted(tuple(r) for r in updates.collect()) == rows
    assert updates.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    vertices = packed.log_vertices(spark, path).collect()
    assert sorted(r.id for r in vertices if not r.temporary) == list(range(40)) and [r.id for r in vertices if r.temporary] == [50, 51]
    assert {r.key: r.value for r in packed.log_properties(spark, path).collect()}["name"] == "x"
    graph = load.load_graph(spark, path)
    assert not graph.directed and graph.num_edges() == len({(a, b) for _, a, b, w in rows} - {(a, b) for _, a, b, w in sorted(rows) if w < 0 and (a, b) not in {(x, y) for s, x, y, v in rows if s > _ and v >= 0}})


def test_written_logs_and_their_numbers(spark, tmp_path):
    rows = log_of(400)
    packed.write_log(spark.createDataFrame(rows, LOG).where("seq >= 7"), f"{tmp_path}/log", rows=60, block=11)
    names = packed.listed(f"{tmp_path}/log")
    assert len(names) >= 7 and all("graphlog" in f for f in names)
    (tmp_path / "log" / "00000-of-a-lost-task.graphlog").write_bytes(b"broken")  # not in the manifest
    found = packed.log_updates(spark, f"file://{tmp_path}/log").collect()
    assert sorted(tuple(r) for r in found) == rows[7:]
    packed.write_log(spark.createDataFrame([], LOG), f"{tmp_path}/none")
    assert packed.log_updates(spark, f"{tmp_path}/none").count() == 0


def test_written_weights_of_zero_stay(spark, tmp_path):
    rows = [(0, 1, 2, 0.0), (1, 1, 3, 4.5), (2, 1, 2, -1.0), (3, 2, 3, 0.0)]
    log = spark.createDataFrame(rows, LOG)
    packed.write_log(log, f"{tmp_path}/log")
    assert sorted(map(tuple, packed.log_updates(spark, f"{tmp_path}/log").collect())) == rows
    content = binary.pack_log(log.coalesce(1), ["updates"])
    assert sorted(map(tuple, binary.log_updates(content).collect())) == rows
    # A log that does not say so has weights made.
    (tmp_path / "old.graphlog").write_bytes(binary.encode_log({}, np.array([1, 2, 3]), np.array([]), pd.DataFrame(rows, columns=["seq", "src", "dst", "weight"]), 8))
    made = sorted(map(tuple, packed.log_updates(spark, f"{tmp_path}/old.graphlog", 2.0).collect()))
    assert [r[3] for r in made[1:3]] == [4.5, -1.0] and all(0 < made[i][3] <= 2 for i in (0, 3))


def test_files_without_numbers_go_on(spark, tmp_path):
    for name, at in (("b", 30), ("a", 0)):
        frame = pd.DataFrame(log_of(60)[at : at + 30], columns=["seq", "src", "dst", "weight"])
        (tmp_path / f"{name}.graphlog").write_bytes(binary.encode_log({}, np.array([1]), np.array([]), frame, 8))
    assert sorted(tuple(r) for r in packed.log_updates(spark, str(tmp_path)).collect()) == log_of(60)


def test_packed_vertices_and_edges(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1, i / 2) for i in range(300)], "src long, dst long, weight double").repartition(3)
    packed.write_packed(edges, f"{tmp_path}/e")
    assert sorted(map(tuple, packed.read_edges(spark, f"{tmp_path}/e").collect())) == sorted(map(tuple, edges.collect()))
    packed.write_packed(edges, f"{tmp_path}/bare", weighted=False)
    bare = packed.read_edges(spark, f"{tmp_path}/bare", False, 2.0).collect()
    assert len(bare) == 300 and all(0 < r.weight <= 2 for r in bare)
    packed.write_packed(spark.range(50), f"{tmp_path}/v")
    assert sorted(r.id for r in packed.read_vertices(spark, f"{tmp_path}/v").collect()) == list(range(50))


@pytest.mark.parametrize("content", [b"", b"# GRAPHLOG\n", b"nothing"])
def test_what_is_no_log(spark, tmp_path, content):
    (tmp_path / "bad.graphlog").write_bytes(content)
    with pytest.raises(Exception, match="no update log"):
        packed.log_updates(spark, f"{tmp_path}/bad.graphlog").count()


def test_cut_streams_and_large_ids(spark, tmp_path):
    whole = zlib.compress(np.arange(100, dtype="<u8").tobytes())
    (tmp_path / "cut").write_bytes(whole[:-6])
    with pytest.raises(Exception, match="ends within a record"):
        packed.read_vertices(spark, f"{tmp_path}/cut").count()
    (tmp_path / "large").write_bytes(zlib.compress(np.array([1 << 63], dtype="<u8").tobytes()))
    with pytest.raises(Exception, match="over 2"):
        packed.read_vertices(spark, f"{tmp_path}/large").count()
    assert not files.readable("viewfs://store/in/x") and files.readable("/tmp/x") and files.readable("file:///tmp/x")
    files.discard(f"file://{tmp_path}/none")
    (tmp_path / "folder").mkdir()
    files.discard(f"{tmp_path}/folder")
    assert not (tmp_path / "folder").exists()
