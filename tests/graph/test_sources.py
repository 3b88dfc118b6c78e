"""Readers and writers on typed-in files, validators, order and statistics."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.statistics import trial_statistics
from vertexloom.graph import Graph
from vertexloom.operators import algebra, validate
from vertexloom.operators.ordering import running, with_next
from vertexloom.session import spread
from vertexloom.sources import binary, load, sinks, text

ARCS = [(1, 2, 10), (1, 3, 100), (1, 4, 200), (2, 1, 10), (2, 4, 10), (3, 1, 100), (3, 4, 10), (4, 1, 200), (4, 2, 10), (4, 3, 10)]


def got(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def test_edge_lists(spark, tmp_path):
    plain, weighted = tmp_path / "a.el", tmp_path / "b.wel"
    plain.write_text("# comment\n\n" + "\n".join(f"  {a}\t{b} more" for a, b, _ in ARCS) + "\n  # end\n")
    weighted.write_text("# c\n" + "\n".join(f"{a} {b} {w} # note" for a, b, w in ARCS) + "\n1 9 0.5\n")
    assert got(text.read_plain(spark, str(plain))) == [(a, b, 1.0) for a, b, _ in ARCS]
    made = got(text.read_plain(spark, str(plain), max_weight=5))
    assert all(w in range(1, 6) for *_, w in made) and made == got(text.read_plain(spark, str(plain), max_weight=5))
    assert got(text.read_weighted(spark, str(weighted))) == sorted([*ARCS, (1, 9, 0.5)])
    assert got(text.read_weighted(spark, str(weighted), lossy_weights=True)) == sorted([*ARCS, (1, 9, 0.0)])
    graph = load.load_graph(spark, str(weighted), directed=False)
    assert graph.num_edges() == 6 and graph.num_vertices() == 5
    with pytest.raises(ValueError):
        load.load_graph(spark, "x.csv")
    with pytest.raises(Exception, match="9999999999999999999"):
        (tmp_path / "c.el").write_text("1 9999999999999999999\n")
        text.read_plain(spark, str(tmp_path / "c.el")).collect()


def test_dimacs(spark, tmp_path):
    path = tmp_path / "a.gr"
    path.write_text("c comment\np sp 4 10\n" + "\n".join(f"a {a} {b} {w}" for a, b, w in ARCS) + "\n a 9 9 9\nabc\n")
    assert got(text.read_dimacs9(spark, str(path))) == ARCS
    assert got(load.load_graph(spark, str(path)).edges) == ARCS


def test_metis(spark, tmp_path):
    lines = {k: " ".join(f"{b} {w}" for a, b, w in ARCS if a == k) for k in range(1, 5)}
    path = tmp_path / "a.graph"
    path.write_text("% c\n4 5 001\n" + "\n".join(f"{lines[k]}\n  % within" for k in lines) + "\n\n\n")
    assert got(text.read_metis(spark, str(path))) == ARCS
    (tmp_path / "b.graph").write_text("3 1 111 2\n5 1 1 2 7\n4 8 8 1 7\n\n")
    assert got(text.read_metis(spark, str(tmp_path / "b.graph"))) == [(1, 2, 7), (2, 1, 7)]
    (tmp_path / "c.graph").write_text("3 1\n2\n1\n\n")
    assert got(text.read_metis(spark, str(tmp_path / "c.graph"))) == [(1, 2, 1), (2, 1, 1)]
    (tmp_path / "d.graph").write_text("1 1\n2\n1\n")
    with pytest.raises(ValueError):
        text.read_metis(spark, str(tmp_path / "d.graph"))
    (tmp_path / "e.graph").write_text("2 1 001\n2 2147483648\n1 2\n")
    with pytest.raises(ValueError):
        text.read_metis(spark, str(tmp_path / "e.graph"))
    (tmp_path / "f.graph").write_text("% nothing\n")
    assert text.read_metis(spark, str(tmp_path / "f.graph")).count() == 0


def properties(tmp_path, more=""):
    path = tmp_path / "g.properties"
    path.write_text(
        f"# head\ngraph.g.vertex-file = g.v\ngraph.g.edge-file = g.e\ngraph.g.directed = Yes\ngraph.g.skipped = x # note\nother.x = 1\n{more}"
    )
    return str(path)


def test_ldbc(spark, tmp_path):
    path = properties(tmp_path, "graph.g.edge-properties.names = weight\n")
    (tmp_path / "g.v").write_text("1\n2\n\n# c\n3\n")
    (tmp_path / "g.e").write_text("1 2 0.5\n2 1 0.25\n")
    found = text.read_properties(spark, path)
    assert "skipped" not in found and "x" not in found and found["directed"] == "Yes"
    graph = load.load_graph(spark, path)
    assert graph.directed and got(graph.edges) == [(1, 2, 0.5), (2, 1, 0.25)] and graph.num_vertices() == 3
    bare = load.load_graph(spark, properties(tmp_path), max_weight=3)
    assert all(0 < w <= 3 for *_, w in got(bare.edges))


def test_ldbc_packed(spark, tmp_path):
    path = properties(tmp_path, "graph.g.edge-properties.names = weight\ngraph.g.compression = zlib\n")
    ids = np.arange(1, 700_000, dtype="<u8")
    (tmp_path / "g.v").write_bytes(zlib.compress(ids.tobytes()))
    edges = np.zeros(3, np.dtype([("s", "<u8"), ("d", "<u8"), ("w", "<f8")]))
    edges["s"], edges["d"], edges["w"] = [1, 2, 3], [2, 3, 1], [0.5, 1.5, 2.5]
    (tmp_path / "g.e").write_bytes(zlib.compress(edges.tobytes()))
    graph = load.load_graph(spark, path)
    assert graph.num_vertices() == len(ids) and got(graph.edges) == [(1, 2, 0.5), (2, 3, 1.5), (3, 1, 2.5)]
    (tmp_path / "g.e").write_bytes(zlib.compress(edges.tobytes()[:-3]))
    with pytest.raises(Exception, match="within a record"):
        load.load_graph(spark, path).edges.collect()


def test_update_log(spark, tmp_path):
    log = pd.DataFrame({"src": [1, 2, 1, 9, 3], "dst": [2, 3, 2, 1, 4], "weight": [1.0, 0.0, -1.0, 2.0, 4.0]})
    path = tmp_path / "a.graphlog"
    path.write_bytes(binary.encode_log({"aging_coeff": 10, "note": "x"}, np.array([1, 2, 3, 4]), np.array([9]), log, 2))
    packed = binary.files(spark, str(path))
    assert {r.key: r.value for r in binary.log_properties(packed).collect()}["aging_coeff"] == "10"
    assert {(r.id, r.temporary) for r in binary.log_vertices(packed).collect()} == {(1, False), (2, False), (3, False), (4, False), (9, True)}
    rows = sorted(map(tuple, binary.log_updates(packed, 3.0).collect()))
    assert [r[:3] for r in rows] == [(0, 1, 2), (1, 2, 3), (2, 1, 2), (3, 9, 1), (4, 3, 4)]
    assert rows[0][3] == 1.0 and 0 < rows[1][3] <= 3 and rows[2][3] == -1.0
    graph = load.load_graph(spark, str(path))
    assert {(r.src, r.dst) for r in graph.edges.collect()} == {(2, 3), (3, 4)}
    assert {r.id for r in graph.vertices.collect()} == {1, 2, 3, 4}


def test_sinks_round_trip(spark, tmp_path):
    result = spark.createDataFrame([(1, 0.5), (2, float("inf"))], "id long, value double")
    sinks.write_result(result, f"{tmp_path}/r")
    assert sorted(map(tuple, sinks.read_result(spark, f"{tmp_path}/r").collect())) == [(1, 0.5), (2, float("inf"))]
    (tmp_path / "twice").write_text("1 2\n1 3\n")
    (tmp_path / "blank").write_text("1 2\n\n2 3\n")
    for bad in ("twice", "blank"):
        with pytest.raises(ValueError):
            sinks.read_result(spark, f"{tmp_path}/{bad}")
    graph = Graph.from_edges(spark.createDataFrame([(1, 2, 1.0), (2, 5, 3.0)], "src long, dst long, weight double"), False)
    sinks.write_metis(graph, f"{tmp_path}/m")
    assert got(text.read_metis(spark, f"{tmp_path}/m")) == [(1, 2, 1), (2, 1, 1), (2, 3, 3), (3, 2, 3)]
    sinks.write_graph_dump(graph, f"{tmp_path}/d")
    assert spark.read.text(f"{tmp_path}/d").collect()[1].value == "[2] 1 (w=1.0), 5 (w=3.0)"


def test_validators(spark):
    frame = lambda rows, kind="double": spark.createDataFrame(rows, f"id long, value {kind}")
    inf = float("inf")
    expected = frame([(1, 1.0), (2, 0.0), (3, inf), (4, inf), (5, 2.0)])
    result = frame([(1, 1.00005), (2, 0.0), (3, inf), (4, 7.0), (6, 1.0)])
    assert {r.id for r in validate.epsilon_mismatches(result, expected).collect()} == {4, 5, 6}
    assert {r.id for r in validate.exact_mismatches(result, expected).collect()} == {1, 4, 5, 6}
    same = validate.equivalence_mismatches(frame([(1, 7), (2, 7), (3, 8)], "long"), frame([(1, 1), (2, 1), (3, 2)], "long"))
    assert same.count() == 0
    merged = validate.equivalence_mismatches(frame([(1, 7), (2, 7), (9, 0)], "long"), frame([(1, 1), (2, 2)], "long"))
    assert {(r.side, r.label) for r in merged.collect()} == {("result", 7), ("missing", 9)}
    with pytest.raises(validate.ValidationError):
        validate.require(merged)
    validate.require(same)
    mapping = spark.createDataFrame([(1, 10), (2, 20)], "id long, other_id long")
    assert sorted(map(tuple, validate.relabelled(frame([(1, 2), (2, 2)], "long"), mapping, True).collect())) == [(10, 20), (20, 20)]


def test_global_order_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1000), i, rng.randrange(9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    found = running(frame, ["a", "b"], "n", {"before": F.col("c")}).collect()
    rows.sort()
    total = 0
    for r, (n, (a, b, c)) in zip(sorted(found, key=lambda r: r.n), enumerate(rows)):
        assert (r.n, r.a, r.b, r.before) == (n, a, b, total)
        total += c
    after = {(r.a, r.b): r.following for r in with_next(frame, ["a", "b"], {"following": "c"}).collect()}
    assert [after[a, b] for a, b, _ in rows] == [c for *_, c in rows[1:]] + [None]


def test_permutations_and_degrees(spark):
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in ARCS], "src long, dst long, weight double")
    graph = Graph.from_edges(edges, True)
    one, two = (algebra.permute(edges, s, "src", "dst").collect() for s in (1, 2))
    assert one != two and sorted(one) == sorted(two)
    assert one == algebra.permute(edges.repartition(3), 1, "src", "dst").collect()
    assert {r.id: r.degree for r in algebra.out_degree(graph).collect()} == {1: 3, 2: 2, 3: 2, 4: 3}
    assert algebra.edge_at(edges, 9).first()[:3] == (4, 3, 10.0)
    with pytest.raises(IndexError):
        algebra.edge_at(edges, 10)
    assert algebra.csr_arcs(graph).count() == len(ARCS)


def test_trial_statistics(spark):
    rng = random.Random(2)
    groups = {"a": [5], "b": [1, 2], "c": [rng.randrange(100) for _ in range(101)] + [-1, -1], "d": [7] * 200 + [9]}
    frame = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x long")
    for r in trial_statistics(frame, ["k"], "x").collect():
        good = sorted(x for x in groups[r.k] if x >= 0)
        n = len(good)
        mean = sum(good) // n
        median = good[n // 2] if n % 2 else (good[n // 2 - 1] + good[n // 2]) // 2
        at = [good[max(p * n // 100 - 1, 0)] for p in (90, 95, 97, 99)]
        expected = (n, len(groups[r.k]) - n, mean, sum(x * x for x in good) // n - mean * mean, good[0], good[-1], median, *at)
        assert tuple(r)[1:] == expected


def test_spread_moves_single_files_only(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/three")
    one, three = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "three"))
    assert spread(one).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert spread(three) is three
    assert spread(one).count() == 100
