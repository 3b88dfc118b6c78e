"""The six kernels against the golden results of two small graphs, and against plain Python on random ones."""

import math
import random
from collections import Counter, defaultdict

import pytest

from vertexloom.graph import Graph
from vertexloom.kernels import arcs, blocks, clustering, ranking, traversal

# Two small graphs and what the kernels give for them.
DIRECTED = """1 3 0.5;1 5 0.3;2 4 0.1;2 5 0.3;2 10 0.12;3 1 0.53;3 5 0.62;3 8 0.21;3 10 0.52;5 3 0.69;5 4 0.53;5 8 0.1;
6 3 0.23;6 4 0.39;7 4 0.83;8 1 0.39;9 4 0.69"""
UNDIRECTED = "2 3 0.9;2 4 0.69;3 4 0.13;3 5 0.5;3 8 0.32;5 6 0.63;5 8 0.12;6 7 0.53;6 8 0.64;6 9 0.23;6 10 0.63;7 9 0.36"
FAR, INF = 9223372036854775807, math.inf
GOLDEN = {
    True: {
        "bfs": {1: 0, 3: 1, 4: 2, 5: 1, 8: 2, 10: 2} | {v: FAR for v in (2, 6, 7, 9)},
        "cdlp": {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 1, 7: 2, 8: 3, 9: 2, 10: 1},
        "sssp": {1: 0, 3: 0.5, 4: 0.83, 5: 0.3, 8: 0.4, 10: 1.02} | {v: INF for v in (2, 6, 7, 9)},
        "pr": {
            1: 0.1477629, 2: 0.04753375, 3: 0.1550469, 4: 0.1597574, 5: 0.14624, 6: 0.04753375, 7: 0.04753375, 8: 0.1135740,
            9: 0.04753375, 10: 0.08748375,
        },
        "lcc": {1: 2 / 3, 2: 1 / 6, 3: 0.15, 4: 0.05, 5: 0.25, 6: 0, 7: 0, 8: 5 / 6, 9: 0, 10: 0},
    },
    False: {
        "bfs": {2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 4, 8: 2, 9: 4, 10: 4},
        "cdlp": {2: 2, 3: 3, 4: 2, 5: 2, 6: 6, 7: 5, 8: 2, 9: 5, 10: 5},
        "sssp": {2: 0, 3: 0.82, 4: 0.69, 5: 1.26, 6: 1.78, 7: 2.31, 8: 1.14, 9: 2.01, 10: 2.41},
        "pr": {
            2: 0.09084491, 3: 0.1424090, 4: 0.09084491, 5: 0.1249892, 6: 0.1686173, 7: 0.09749537, 8: 0.1249892, 9: 0.09749537,
            10: 0.06231481,
        },
        "lcc": {2: 1, 3: 1 / 3, 4: 1, 5: 2 / 3, 6: 0.2, 7: 1, 8: 2 / 3, 9: 1, 10: 0},
    },
}


def build(spark, rows, directed, vertices=None):
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    ids = None if vertices is None else spark.createDataFrame([(v,) for v in vertices], "id long")
    return Graph.from_edges(edges, directed, ids)


def golden(spark, directed):
    rows = [(int(a), int(b), float(w)) for a, b, w in (x.split() for x in (DIRECTED if directed else UNDIRECTED).split(";"))]
    return build(spark, rows, directed, range(1, 11) if directed else range(2, 11))


def values(df):
    rows = df.collect()
    out = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_golden_results(spark, directed):
    graph, expected = golden(spark, directed), GOLDEN[directed]
    graph.check()
    source = 1 if directed else 2
    assert values(traversal.bfs(graph, source)) == expected["bfs"]
    assert values(traversal.sssp(graph, source)) == pytest.approx(expected["sssp"])
    assert values(ranking.cdlp(graph, 2)) == expected["cdlp"]
    assert values(ranking.pagerank(graph, 2)) == pytest.approx(expected["pr"], rel=1e-5)
    assert values(clustering.lcc(graph)) == pytest.approx(expected["lcc"])
    assert set(values(clustering.wcc(graph)).values()) == {source}


def random_graph(seed, n, m, directed):
    rng = random.Random(seed)
    pairs = {(a, b) if directed or a < b else (b, a) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    return [(a, b, rng.choice([0.0, 0.5, 1.0, 2.5])) for a, b in sorted(pairs)]


@pytest.mark.parametrize("directed", [True, False])
def test_random_graph_with_isolated_vertices(spark, directed):
    rows, n = random_graph(3, 40, 45, directed), 42
    graph = build(spark, rows, directed, range(n))
    out, both = defaultdict(dict), defaultdict(Counter)
    for a, b, w in rows:
        out[a][b] = w
        both[a][b] += 1
        both[b][a] += 1
        if not directed:
            out[b][a] = w
    hops, edge, distance = {0: 0}, [0], {v: INF for v in range(n)} | {0: 0.0}
    while edge:
        edge = [b for b in {b for a in edge for b in out[a]} if hops.setdefault(b, hops[edge[0]] + 1) == hops[edge[0]] + 1]
    for _ in range(n):
        for a in list(out):
            for b, w in out[a].items():
                distance[b] = min(distance[b], distance[a] + w)
    assert values(traversal.bfs(graph, 0)) == {v: hops.get(v, FAR) for v in range(n)}
    assert values(traversal.sssp(graph, 0)) == pytest.approx(distance)
    component = {v: v for v in range(n)}
    for _ in range(n):
        for a, b, _ in rows:
            component[a] = component[b] = min(component[a], component[b])
    assert values(clustering.wcc(graph)) == component
    rank = {v: 1 / n for v in range(n)}
    for _ in range(4):
        lost = sum(r for v, r in rank.items() if not out[v])
        new = {v: 0.15 / n + 0.85 * lost / n for v in range(n)}
        for a in list(out):
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    assert values(ranking.pagerank(graph, 4)) == pytest.approx(rank)
    assert sum(rank.values()) == pytest.approx(1)
    label = {v: v for v in range(n)}
    for _ in range(3):
        counts = {v: Counter() for v in range(n)}
        for v in range(n):
            for u, k in both[v].items():
                counts[v][label[u]] += k if directed else 1
        label = {v: min((-k, x) for x, k in counts[v].items())[1] if counts[v] else label[v] for v in range(n)}
    assert values(ranking.cdlp(graph, 3)) == label
    alone = {v for v in range(n) if not both[v]}
    assert values(ranking.cdlp(graph, 3, isolated_label=-5)) == {v: -5 if v in alone else x for v, x in label.items()}
    coefficient = {}
    for v in range(n):
        near = set(both[v])
        arcs = sum(w in out[u] for u in near for w in near)
        coefficient[v] = arcs / (len(near) * (len(near) - 1)) if len(near) > 1 else 0.0
    assert values(clustering.lcc(graph)) == pytest.approx(coefficient)


def test_long_path_and_star_components(spark):
    path = [(i, i + 1, 1.0) for i in range(200)]
    star = [(1000, 1001 + i, 1.0) for i in range(500)]
    graph = build(spark, path + star, False)
    found = values(clustering.wcc(graph))
    assert Counter(found.values()) == {0: 201, 1000: 501}


def test_errors(spark):
    graph = golden(spark, True)
    with pytest.raises(KeyError):
        traversal.bfs(graph, 77)
    with pytest.raises(TimeoutError):
        ranking.pagerank(graph, 50, timeout=1e-9)
    with pytest.raises(ValueError):
        build(spark, [(1, 1, 1.0)], True).check()
    with pytest.raises(ValueError):
        build(spark, [(1, 2, 1.0), (2, 1, 1.0)], False).check()
    with pytest.raises(ValueError):
        traversal.sssp(build(spark, [(1, 2, -1.0)], True), 1)


@pytest.mark.parametrize("directed", [True, False])
def test_arcs_of_hubs_in_parts(spark, directed, monkeypatch):
    monkeypatch.setattr(arcs, "HUB", 2)
    test_golden_results(spark, directed)
    edges = spark.range(1, 200).selectExpr("0L as src", "id as dst", "1.0 as weight")
    held = arcs.HeldArcs(edges)
    assert held.arcs.select("part").distinct().count() > 50
    met = held.meet(spark.createDataFrame([(0, "x"), (7, "y")], "id long, name string"), "id")
    assert sorted(r.dst for r in met.collect()) == list(range(1, 200)) and met.columns == ["id", "name", "src", "dst", "weight"]


def test_shortest_paths_that_keep_falling(spark):
    """A chain of cheap arcs beside dear direct ones: every distance falls after it was first found, over many rounds."""
    n = 2 * traversal.COMPACT + 3
    rows = [(k, k + 1, 1.0) for k in range(n)] + [(0, k, 3.0 * k) for k in range(2, n + 1)]
    found = {r.id: r.distance for r in traversal.sssp(build(spark, rows, True), 0).collect()}
    assert found == {k: float(k) for k in range(n + 1)}


@pytest.mark.parametrize("directed", [True, False])
def test_ways_of_breadth_first_search(spark, directed):
    rng = random.Random(61)
    pairs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(110)) if a < b}
    arrows = [(a, b, 1.0) if rng.random() < 0.7 or not directed else (b, a, 1.0) for a, b in sorted(pairs)]
    graph = build(spark, arrows, directed, range(42))
    source = Counter(a for a, *_ in arrows).most_common(1)[0][0]
    expected = values(traversal.bfs(graph, source, direction="push"))
    assert expected == values(traversal.bfs(graph, source, direction="pull")) == values(traversal.bfs(graph, source, direction="auto"))
    assert len(set(expected.values())) > 3
    with pytest.raises(ValueError):
        traversal.bfs(graph, source, direction="sideways")


@pytest.mark.parametrize("directed", [True, False])
def test_delta_stepping_on_golden_graphs(spark, directed):
    graph = golden(spark, directed)
    source = 1 if directed else 2
    expected = GOLDEN[directed]["sssp"]
    for delta in (None, 0.2):
        found = values(traversal.delta_stepping(graph, source, delta))
        assert found.keys() == expected.keys() and all(found[v] == pytest.approx(expected[v]) for v in expected)


def test_delta_stepping_writes_less_on_a_long_path(spark, monkeypatch):
    """Short steps along a path, and from each vertex a long way ahead that the path beats."""
    n = 10
    rows = [(i, i + 1, 1.0) for i in range(n)] + [(0, i, 5.0 * i) for i in range(2, n + 1)] + [(i, i + 4, 30.0) for i in range(n - 4)]
    rows += [(n, 100, 1.0), (100, 101, 0.0)]
    rows += [(i, 200 + i, 2.0) for i in range(n)]
    graph = build(spark, rows, True)
    plain, kept = [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: plain.append(kept(df)) or plain[-1])
    expected = values(traversal.sssp(graph, 0))
    rounds = sum(df.count() for df in plain if set(df.columns) == {"id", "distance"}) - len(expected)
    monkeypatch.setattr(traversal, "cut", kept)
    written = []
    assert values(traversal.delta_stepping(graph, 0, 3.0, written=written)) == expected
    assert expected[101] == 11.0 and sum(written) < rounds
    with pytest.raises(ValueError):
        traversal.delta_stepping(build(spark, [(1, 2, -1.0)], True), 1)
    assert values(traversal.delta_stepping(build(spark, [(1, 2, 0.0)], True), 1)) == {1: 0, 2: 0}


@pytest.mark.parametrize("directed", [True, False])
def test_ranks_over_blocks(spark, directed):
    graph = golden(spark, directed)
    expected = GOLDEN[directed]["pr"]
    for size, part in ((1 << 16, 1 << 20), (3, 2)):
        found = values(blocks.pagerank_blocks(graph, 2, size=size, part_arcs=part))
        assert found.keys() == expected.keys() and all(found[v] == pytest.approx(expected[v], rel=1e-4) for v in expected)
    held = blocks.ArcBlocks(graph, 3, 2).blocks.collect()
    assert max(len(b.targets) for b in held) <= 2 and sum(len(b.targets) for b in held) == graph.arcs.count()
    assert any(b.part > 0 for b in held) and all(len(b.offsets) == len(b.sources) + 1 for b in held)
    assert blocks.pagerank_blocks(build(spark, [], directed), 2).count() == 0
