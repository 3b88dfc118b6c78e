"""METIS files: a line costs what its words are, and lines are held once, compressed."""

import time
from pathlib import Path

from vertexloom.graph import Graph
from vertexloom.session import ensure_checkpoint_dir
from vertexloom.sources import sinks, text


def test_a_long_line(spark, tmp_path):
    """A hub's words are not copied for each of its neighbours."""
    n = 100_000
    (tmp_path / "hub.graph").write_text(f"{n + 1} {n} 001\n" + " ".join(f"{k} {k % 9}" for k in range(2, n + 2)) + "\n" + "\n".join(f"1 {k % 9}" for k in range(2, n + 2)) + "\n")
    began = time.time()
    arcs = text.read_metis(spark, str(tmp_path / "hub.graph"))
    assert arcs.count() == 2 * n and arcs.where("src = 1 and weight = dst % 9").count() == n
    assert time.time() - began < 60


def _bytes(folder):
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())


def test_lines_are_not_kept(spark, tmp_path):
    """What is left of reading is the arcs, smaller than the text."""
    edges = spark.range(20_000).selectExpr("id as src", "id + 1 + id % 7 as dst", "double(id % 5) as weight")
    alone = spark.range(30_000).select("id")
    graph = Graph.from_edges(edges, False, alone)
    for name, compression in (("plain", "none"), ("packed", "gzip")):
        sinks.write_metis(graph, f"{tmp_path}/{name}", compression)
    size, before = _bytes(f"{tmp_path}/plain"), _bytes(ensure_checkpoint_dir(spark))
    arcs = text.read_metis(spark, f"{tmp_path}/plain")
    assert _bytes(ensure_checkpoint_dir(spark)) - before < size
    expected = sorted((a + 1, b + 1, w) for s, d, w in edges.collect() for a, b in ((s, d), (d, s)))
    assert sorted(map(tuple, arcs.collect())) == expected == sorted(map(tuple, text.read_metis(spark, f"{tmp_path}/packed").collect()))
    lines = [r.line for r in text.numbered_lines(spark, f"{tmp_path}/packed", "%").orderBy("number").collect()]
    assert lines[0] == "30000 20000 001" and len(lines) == 30_001 and lines[-1] == ""
