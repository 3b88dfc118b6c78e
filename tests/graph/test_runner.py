"""Whole runs and their records; statistics, limits and checks of odd inputs."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.statistics import trial_statistics
from vertexloom.graph import Graph
from vertexloom.kernels.deadline import limited
from vertexloom.operators import validate
from vertexloom.plans import runner
from vertexloom.sources import binary, load, packed, sinks, text

PROPERTIES = """# a comment
graph.tiny.vertex-file = tiny.v
graph.tiny.edge-file = tiny.e
graph.tiny.directed = false
graph.tiny.edge-properties.names = weight
graph.tiny.algorithms = bfs, cdlp, pr, sssp, wcc, lcc
graph.tiny.bfs.source-vertex = 1
graph.tiny.sssp.source-vertex = 2
graph.tiny.cdlp.max-iterations = 2
graph.tiny.pr.num-iterations = 3
graph.tiny.pr.damping-factor = 0.5
graph.other.directed = true
"""
EDGES = [(1, 2, 0.5), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 1.0)]


@pytest.fixture()
def dataset(tmp_path):
    (tmp_path / "tiny.properties").write_text(PROPERTIES)
    (tmp_path / "tiny.v").write_text("1\n2\n3\n4\n5\n")
    (tmp_path / "tiny.e").write_text("".join(f"{s} {d} {w}\n" for s, d, w in EDGES))
    (tmp_path / "tiny-BFS").write_text("1 0\n2 1\n3 1\n4 2\n5 9223372036854775807\n")
    (tmp_path / "tiny-SSSP").write_text("1 0.5\n2 0\n3 1\n4 2\n5 infinity\n")
    (tmp_path / "tiny-WCC").write_text("1 7\n2 7\n3 8\n4 7\n5 9\n")  # 3 is wrong
    return tmp_path


def test_parameters_of_a_dataset(spark, dataset):
    p = text.read_properties(spark, f"{dataset}/tiny.properties")
    assert not text.is_directed(p)
    assert text.kernel_parameters(p) == {
        "bfs": {"source": 1}, "sssp": {"source": 2}, "cdlp": {"iterations": 2}, "pagerank": {"iterations": 3, "damping": 0.5}, "wcc": {}, "lcc": {},
    }
    assert set(text.kernel_parameters({})) == {"cdlp", "lcc", "pagerank", "wcc"}
    assert text.kernel_parameters({"algorithms": "bfs", "bfs.source-vertex": "3"}) == {"bfs": {"source": 3}, "sssp": {"source": 3}}
    for wrong in ({"algorithms": "bfs"}, {"algorithms": "pr, tc"}):
        with pytest.raises(ValueError):
            text.kernel_parameters(wrong)


def test_a_run_keeps_its_records(spark, dataset):
    records = f"{dataset}/records"
    options = runner.Options(f"{dataset}/tiny.properties", records, repetitions=2, batches=2, validate=f"{dataset}/tiny", without=("cdlp", "pagerank", "lcc"))
    one = runner.run(spark, options)
    table = lambda name: [r for r in runner.read_records(spark, records, name).collect() if r.run == one]
    assert {r.name: r.value for r in table("parameters")}["batches"] == "2"
    assert [r.kernel for r in sorted(table("kernels"), key=lambda r: (r.trial, r.kernel))] == ["bfs", "sssp", "wcc", "bfs", "sssp"]
    assert {r.kernel: r.valid for r in table("validation")} == {"bfs": True, "sssp": True, "wcc": False}
    assert {r.kernel: (r.n, r.timeouts) for r in table("statistics")} == {"bfs": (2, 0), "sssp": (2, 0), "wcc": (0, 1)}
    batches = sorted(table("batches"), key=lambda r: r.version)
    assert [(r.version, r.updates, r.inserts, r.deletes) for r in batches] == [(1, 2, 2, 0), (2, 2, 2, 0)]
    assert [(r.multiple, r.updates) for r in table("progress")] == [(1, 4)]
    assert [(r.updates, r.edges, r.vertices) for r in table("totals")] == [(4, 4, 4)]
    assert runner.run(spark, runner.Options(f"{dataset}/tiny.properties", records, repetitions=0, insert=False)) != one
    assert runner.read_records(spark, records, "parameters").select("run").distinct().count() == 2


def test_groups_of_timeouts_and_without_a_name(spark):
    rows = [("a", 5), ("a", -1), ("b", -1), (None, 7), (None, 8), (None, -1)]
    found = {r.k: r for r in trial_statistics(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()}
    assert {k: (r.n, r.timeouts, r["median"], r.p99) for k, r in found.items()} == {"a": (1, 1, 5, 5), "b": (0, 1, None, None), None: (2, 1, 7, 7)}
    assert trial_statistics(spark.createDataFrame(rows, "k string, v long"), [], "v").first().n == 3


def test_a_limit_between_jobs(spark):
    def slow():
        for _ in range(6):
            spark.range(10).count()
            time.sleep(0.4)
        return 1

    with pytest.raises(TimeoutError):
        limited(spark, 1, slow)
    assert limited(spark, 60, lambda: spark.range(3).count()) == 3


def test_all_mismatches_are_reported(spark, tmp_path):
    one, other = spark.range(3000).select("id", F.lit(1)), spark.range(3000).select("id", F.lit(2))
    with pytest.raises(validate.ValidationError, match="3000 mismatches"):
        validate.require(validate.exact_mismatches(one, other), 0, f"{tmp_path}/report")
    validate.require(validate.exact_mismatches(one, one), 0, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        validate.require(validate.exact_mismatches(one, other), 0)


def test_remapping_needs_equal_sets(spark):
    one = spark.range(3).select(F.col("id").alias("position"), (F.col("id") * 10).alias("id"))
    assert validate.remap_vertices(one, one).count() == 3
    with pytest.raises(ValueError):
        validate.remap_vertices(one, one.where("position < 2"))


def test_numbers_go_on_over_a_logs_files(spark):
    log = spark.range(100).select(F.col("id").alias("seq"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    packed = binary.pack_log(log, ["updates"], block=7, file_rows=30)
    found = binary.log_updates(packed).collect()
    assert packed.count() > 3 and sorted((r.seq, r.src) for r in found) == [(i, i) for i in range(100)]


def test_a_repeated_edge_gets_its_smallest_weight(spark, tmp_path):
    (tmp_path / "g.wel").write_text("1 2 5\n2 1 3\n1 2 4\n")
    graph = load.load_graph(spark, f"{tmp_path}/g.wel", directed=False)
    graph.check()
    assert isinstance(graph, Graph) and [tuple(r) for r in graph.edges.collect()] == [(1, 2, 3.0)]


def log_file(folder, updates, final, temporary, **told):
    names = {"vertices": binary.FINAL_VERTICES, "edges": binary.FINAL_EDGES}
    frame = pd.DataFrame(updates, columns=["src", "dst", "weight"])
    content = binary.encode_log({names[k]: v for k, v in told.items()}, np.array(final), np.array(temporary), frame, 4)
    (folder / "tiny.graphlog").write_bytes(content)
    return f"{folder}/tiny.graphlog"


UPDATES = [(1, 2, 0.5), (2, 3, 1.0), (1, 9, 2.0), (3, 4, 1.0), (2, 1, -1.0), (1, 3, 2.0), (1, 2, 0.7), (9, 4, 1.0)]


def test_a_replayed_log(spark, dataset):
    path = log_file(dataset, UPDATES, [1, 2, 3, 4], [9], vertices=4, edges=4)
    records = f"{dataset}/records"
    one = runner.run(spark, runner.Options(f"{dataset}/tiny.properties", records, log=path, repetitions=0, batch=3, aging_step=0.5, latency=True, scans=2))
    table = lambda name: [r for r in runner.read_records(spark, records, name).collect() if r.run == one]
    assert sorted((r.version, r.updates, r.inserts, r.deletes) for r in table("batches")) == [(1, 3, 3, 0), (2, 3, 2, 1), (3, 2, 2, 0)]
    (total,) = table("totals")
    assert (total.vertices, total.edges, total.expected_vertices, total.expected_edges, total.temporary_vertices) == (4, 4, 4, 4, 1)
    assert (total.snapshots, total.timed_out, total.updates) == (3, False, 8) and total.build_microseconds > 0
    assert sorted((r.multiple, r.updates) for r in table("progress")) == [(0.5, 3), (1.0, 6), (1.5, 6), (2.0, 8)]
    assert max(r.updates for r in table("seconds")) == 8
    assert {r.kind: (r.n, r.timeouts) for r in table("latencies")} == {"insert": (7, 0), "delete": (1, 0), "all": (8, 0)}
    assert sorted(r.trial for r in table("scans")) == [0, 0, 0, 1, 1, 1]
    assert {r.scan for r in spark.read.json(f"{records}/scans-{one}.json").collect()} == {"degrees", "first_neighbour", "all_neighbours"}
    assert spark.read.text(f"{records}/degrees-{one}").count() == 5
    with pytest.raises(ValueError, match="4 edges instead of 5"):
        log_file(dataset, UPDATES, [1, 2, 3, 4], [9], vertices=4, edges=5)
        runner.run(spark, runner.Options(f"{dataset}/tiny.properties", records, log=path, repetitions=0, batches=1))


def test_a_log_through_state_and_one_that_is_stopped(spark, dataset):
    path = log_file(dataset, UPDATES, [1, 2, 3, 4], [9], vertices=4, edges=4)
    records = f"{dataset}/records"
    runner.run(spark, runner.Options(f"{dataset}/tiny.properties", records, log=path, repetitions=0, batches=2, build_every=1))
    runner.run(spark, runner.Options(f"{dataset}/tiny.properties", records, log=path, repetitions=0, batches=8, aging_timeout=0.5))
    totals = runner.read_records(spark, records, "totals").orderBy("timed_out").collect()
    assert (totals[0].edges, totals[0].updates, totals[0].timed_out) == (4, 8, False) and totals[0].snapshots >= 1
    assert totals[1].timed_out and totals[1].updates < 8 and totals[1].edges <= 4


def test_a_directed_graph_is_loaded_only(spark, dataset):
    (dataset / "tiny.properties").write_text(PROPERTIES.replace("tiny.directed = false", "tiny.directed = true"))
    options = {"graph": f"{dataset}/tiny.properties", "records": f"{dataset}/records", "repetitions": 0}
    with pytest.raises(ValueError, match="load"):
        runner.run(spark, runner.Options(**options))
    assert runner.run(spark, runner.Options(**options, load=True))


def test_a_dataset_with_other_names_is_validated(spark, dataset):
    """The dataset renamed in the order of its vertex file, which is not that of the ids; results are of the first."""
    new = {5: 70, 1: 8, 4: 31, 2: 90, 3: 11}
    (dataset / "tiny.v").write_text("".join(f"{v}\n" for v in new))
    packed.write_packed(spark.createDataFrame([(v,) for v in new.values()], "id long").coalesce(1), f"{dataset}/renamed.vz")
    packed.write_packed(spark.createDataFrame([(new[a], new[b], w) for a, b, w in EDGES], "src long, dst long, weight double"), f"{dataset}/renamed.ez")
    own = PROPERTIES.replace("graph.tiny.", "graph.renamed.").replace("tiny.v", "renamed.vz").replace("tiny.e", "renamed.ez")
    own = own.replace("bfs.source-vertex = 1", "bfs.source-vertex = 8").replace("sssp.source-vertex = 2", "sssp.source-vertex = 90")
    own += "graph.renamed.compression = zlib\ngraph.renamed.meta.vertices = 5\n"
    (dataset / "tiny.properties").write_text(PROPERTIES + "graph.tiny.meta.vertices = 5\n")
    options = {"graph": f"{dataset}/renamed.properties", "records": f"{dataset}/records", "repetitions": 1, "load": True, "validate": f"{dataset}/tiny", "remap": f"{dataset}/tiny.properties", "without": ("pagerank", "lcc", "cdlp", "wcc")}
    (dataset / "renamed.properties").write_text(own)
    with pytest.raises(ValueError, match="stable-map"):
        runner.run(spark, runner.Options(**options))
    (dataset / "renamed.properties").write_text(own + "graph.renamed.meta.stable-map = true\n")
    one = runner.run(spark, runner.Options(**options))
    told = {r.kernel: (r.valid, r.error) for r in runner.read_records(spark, options["records"], "validation").where(F.col("run") == one).collect()}
    assert told == {"bfs": (True, None), "sssp": (True, None)}
    (dataset / "tiny.properties").write_text(PROPERTIES + "graph.tiny.meta.vertices = 6\n")
    with pytest.raises(ValueError, match="meta.vertices"):
        runner.run(spark, runner.Options(**options))


def test_a_hubs_lines(spark, tmp_path):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 24)] + [(30, 31, 2.0)], "src long, dst long, weight double")
    graph = Graph.from_edges(edges, False, spark.createDataFrame([(i,) for i in [*range(24), 30, 31, 40]], "id long"))
    rows = sinks.adjacency_lines(graph, 10).collect()
    hub = sorted((r.part, r.line) for r in rows if r.id == 0)
    assert [p for p, _ in hub] == [0, 1, 2] and [line.count("w=") for _, line in hub] == [10, 10, 3]
    assert hub[1][1].startswith("[0] 11 (w=1.0), 12") and len(rows) == 23 + 3 + 3
    whole = {r.id: r.line for r in sinks.adjacency_lines(graph).collect()}
    assert whole[0] == "[0] " + ", ".join(line.removeprefix("[0] ") for _, line in hub) and whole[40] == "[40] " and whole[30] == "[30] 31 (w=2.0)"
