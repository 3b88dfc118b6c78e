"""Triangles by ranges of vertices: all are found whatever the bounds, and lists are sent once for each range."""

import numpy as np
import pandas as pd
import pytest

from vertexloom.graph import Graph
from vertexloom.kernels import clustering
from vertexloom.operators import algebra, closing

EDGES = [(0, i) for i in range(1, 40)] + [(i, j) for i in range(1, 40) for j in range(i + 1, 40) if (i * j) % 7 < 2]
#: Bounds of a range, a chunk, a task and a test, and ranked vertices: as they are, and so small that all are met.
BOUNDS = [(1 << 24, 1 << 17, 1 << 24, 1 << 21, 1 << 18), (64, 20, 30, 7, 4)]


def neighbours():
    found = {}
    for a, b in EDGES:
        found.setdefault(a, set()).add(b)
        found.setdefault(b, set()).add(a)
    return found


@pytest.fixture(params=BOUNDS)
def graph(spark, monkeypatch, request):
    for name, value in zip(("RANGE_DEGREES", "CHUNK_ARCS", "DEALT_ARCS", "TESTED"), request.param):
        monkeypatch.setattr(closing, name, value)
    monkeypatch.setattr(algebra, "RANKED", request.param[-1])
    return Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in EDGES], "src long, dst long, weight double"), False)


def test_triangle_count(graph):
    expected = sum(len(neighbours()[a] & neighbours()[b]) for a, b in EDGES) // 3
    assert expected > 100 and clustering.triangle_count(graph).first()["triangles"] == expected


def test_a_list_is_sent_once_for_each_range():
    """The list of a vertex with 50 neighbours in two ranges comes to these two, not to 50 vertices."""
    a, b = np.repeat(np.arange(10), 50), np.tile(np.arange(100, 150), 10)
    chunks = pd.concat(closing._deal(np.array([100, 125]))(iter([pd.DataFrame({"a": a, "b": b})])))
    assert sorted(zip(chunks["part"], chunks["own"], chunks["arcs"])) == [(0, True, 500), (1, False, 500), (2, False, 500)]
    for xs in (a, b, np.array([5, -7, 2**62, -(2**62), 9]), np.array([3])):
        assert (closing._spread(closing._squeeze(xs)) == xs).all()


def test_triangles_per_vertex(graph):
    near = neighbours()
    expected = {v: sum(len(near[v] & near[w]) for w in near[v]) // 2 for v in near}
    assert {r["id"]: r["triangles"] for r in clustering.triangles_per_vertex(graph).collect()} == {v: n for v, n in expected.items() if n}


@pytest.mark.parametrize("directed", [False, True])
def test_lcc(graph, directed):
    graph = graph if not directed else Graph.from_edges(graph.edges, True)
    near = neighbours()
    share = {v: sum(len(near[v] & near[w]) for w in near[v]) / (1 + directed) / (len(near[v]) * (len(near[v]) - 1)) for v in near if len(near[v]) > 1}
    found = {r["id"]: r["coefficient"] for r in clustering.lcc(graph).collect()}
    assert found.keys() == near.keys() and all(found[v] == pytest.approx(share.get(v, 0)) for v in near)


def test_common_neighbours(graph):
    near = neighbours()
    expected = {(a, b): len(near[a] & near[b]) for a, b in EDGES}
    assert {(r["src"], r["dst"]): r["n"] for r in algebra.common_neighbours(graph).collect()} == {e: n for e, n in expected.items() if n}
