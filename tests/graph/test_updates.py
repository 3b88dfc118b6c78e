"""Updates against a graph that is changed one operation at a time."""

import random

import pytest

from vertexloom.graph import Graph
from vertexloom.operators import updates, validate
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.streaming import replay

EDGES = "src long, dst long, weight double"


def empty(spark, directed=False):
    return Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], EDGES), directed)


def rows_of(graph):
    return {(r.src, r.dst): r.weight for r in graph.edges.collect()}


def sequential(edges, log, directed, policy):
    now = dict(edges)
    for _, a, b, w in sorted(log):
        key = (a, b) if directed else (min(a, b), max(a, b))
        if w < 0:
            now.pop(key, None)
        elif policy == "overwrite" or key not in now:
            now[key] = w
    return now


def random_log(seed, n=400):
    rng = random.Random(seed)
    ends = [(rng.randrange(8), 8 + rng.randrange(8)) for _ in range(n)]
    return [(i, *(e if rng.random() < 0.5 else e[::-1]), -1.0 if rng.random() < 0.4 else round(rng.random(), 3)) for i, e in enumerate(ends)]


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("policy", ["ignore", "overwrite"])
def test_batch_equals_one_by_one(spark, directed, policy):
    first, second = random_log(1)[:150], random_log(2, 120)
    log = lambda x: spark.createDataFrame(x, "seq long, src long, dst long, weight double")
    graph = updates.apply_batch(empty(spark, directed), log(first), policy)
    expected = sequential({}, first, directed, policy)
    assert rows_of(graph) == expected
    graph = updates.apply_batch(graph, log(second), policy)
    assert rows_of(graph) == sequential(expected, second, directed, policy)
    graph.check()


def test_synthetic_graph_by_edges(spark):
    """Edge (i, j) is there if j - i is even, with weight j * 1000 + i; put in turned at random, then taken out."""
    n, rng = 30, random.Random(5)
    rows = [(i, j, float(j * 1000 + i)) for i in range(1, n) for j in range(i + 1, n) if (j - i) % 2 == 0]
    rng.shuffle(rows)
    turned = [r if rng.random() < 0.5 else (r[1], r[0], r[2]) for r in rows]
    graph, told = updates.add_edges_v2(empty(spark), spark.createDataFrame(turned, EDGES))
    assert all(r.accepted for r in told.collect())
    probes = spark.createDataFrame([(i, j) for i in range(1, n) for j in range(1, n) if i != j], "src long, dst long")
    for r in graph.get_weight(probes).collect():
        low, high = sorted((r.src, r.dst))
        assert r.weight == (high * 1000 + low if (high - low) % 2 == 0 else None)
    assert graph.num_edges() == len(rows) and graph.num_vertices() == n - 1
    again, told = updates.add_edges(graph, spark.createDataFrame([(1, 3, 5.0), (1, 2, 6.0), (1, 99, 7.0)], EDGES))
    assert {(r.src, r.dst): r.accepted for r in told.collect()} == {(1, 3): False, (1, 2): True, (1, 99): False}
    over, _ = updates.add_edges(graph, spark.createDataFrame([(3, 1, 5.0)], EDGES), "overwrite")
    assert rows_of(over)[1, 3] == 5.0 and over.num_edges() == len(rows)
    assert again.weight_of(2, 1) == 6.0 and again.weight_of(1, 99) != again.weight_of(1, 99)
    assert validate.update_mismatches(graph, spark.createDataFrame(rows, EDGES)).count() == 0
    fewer = updates.remove_vertices(graph, spark.createDataFrame([(1,), (2,)], "id long"))
    assert rows_of(fewer) == {(a, b): w for a, b, w in rows if a > 2} and fewer.num_vertices() == n - 3
    bare, told = updates.remove_edges(graph, spark.createDataFrame([(b, a) for a, b, _ in rows] + [(1, 2)], "src long, dst long"))
    assert bare.num_edges() == 0 and bare.num_vertices() == n - 1
    assert sum(not r.accepted for r in told.collect()) == 1


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    log = random_log(9)
    frame = spark.createDataFrame(log, "seq long, src long, dst long, weight double")
    replay.write_segments(frame, f"{tmp_path}/log", 4, files=2)
    store = SnapshotStore(spark, f"{tmp_path}/versions", directed=False)
    assert store.versions() == []
    records = replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress", files=2).records
    assert sum(r["updates"] for r in records) == len(log) and len(store.versions()) == len(records)
    assert rows_of(store.load()) == sequential({}, log, False, "ignore")
    assert replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress", files=2).records == []


def test_final_counts_and_parts(spark):
    log = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 9, 1, 1.0), (3, 1, 2, -1.0)], "seq long, src long, dst long, weight double")
    graph = updates.apply_batch(empty(spark), log)
    left, counts = updates.final_counts(graph, spark.createDataFrame([(9,)], "id long"))
    assert {r.what: r.n for r in counts.collect()} == {"vertices": 3, "edges": 1}
    parts = updates.partition_updates(log, 2).collect()
    assert all(r.worker == (r.src + r.dst) % 2 for r in parts)
