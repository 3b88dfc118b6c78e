"""Experiments on small graphs."""

import time

import pytest

from tests.graph.test_kernels import GOLDEN, golden
from tests.graph.test_updates import random_log, rows_of, sequential
from vertexloom.functions.quantities import parse_bytes, parse_duration
from vertexloom.kernels.deadline import limited
from vertexloom.plans import experiments
from vertexloom.sources import sinks


def test_insert_only(spark, tmp_path):
    edges = golden(spark, False).edges
    store, records = experiments.insert_only(edges, str(tmp_path), 3, seed=1)
    records = records.records
    assert len(store.versions()) == len(records) == 3 and sum(r["updates"] for r in records) == 12
    assert rows_of(store.load()) == {(r.src, r.dst): r.weight for r in edges.collect()}


def test_aging(spark, tmp_path):
    log = random_log(11)
    frame = spark.createDataFrame(log, "seq long, src long, dst long, weight double")
    gone = spark.createDataFrame([(3,), (9,)], "id long")
    graph, records = experiments.aging(frame, gone, str(tmp_path), 3)
    expected = {k: w for k, w in sequential({}, log, False, "ignore").items() if not {3, 9} & set(k)}
    assert rows_of(graph) == expected and sum(r["updates"] for r in records.records) == len(log)


def test_kernel_suite(spark, tmp_path):
    graph = golden(spark, False)
    frame = lambda name, kind: spark.createDataFrame(sorted((k, float(v) if kind == "double" else v) for k, v in GOLDEN[False][name].items()), f"id long, value {kind}")
    expected = {"bfs": frame("bfs", "long"), "cdlp": frame("cdlp", "long"), "lcc": frame("lcc", "double"), "sssp": frame("sssp", "double")}
    expected["pagerank"] = spark.createDataFrame([(2, 0.5)], "id long, value double")
    records = experiments.kernel_suite(graph, 2, repetitions=2, without=["wcc"], expected=expected, iterations=2)
    by = {}
    for r in records:
        by.setdefault(r["kernel"], []).append(r["microseconds"])
    assert by.pop("pagerank") == [-1] and "wcc" not in by
    assert sorted(by) == ["bfs", "cdlp", "lcc", "sssp"] and all(len(v) == 2 and min(v) > 0 for v in by.values())
    stats = {r.kernel: r for r in experiments.suite_statistics(spark, records).collect()}
    assert stats["bfs"].n == 2 and stats["bfs"].min == min(by["bfs"])
    sinks.write_records(spark, [{"kernel": r["kernel"], "us": r["microseconds"]} for r in records], f"{tmp_path}/records")
    assert spark.read.parquet(f"{tmp_path}/records").count() == len(records)


def test_scans_and_limits(spark):
    records = experiments.scan_benchmark(golden(spark, False), 2)
    assert {r["scan"]: r["total"] for r in records}["degrees"] == 24
    assert limited(spark, 60, lambda: spark.range(10).count()) == 10
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        limited(spark, 2, lambda: spark.range(0, 1 << 40, 1, 8).selectExpr("sum(hash(id))").collect())
    assert time.monotonic() - began < 30


def test_quantities():
    assert [parse_duration(x) for x in ("90", "10s", "5m", "4h", "1d")] == [90, 10, 300, 14400, 86400]
    assert [parse_bytes(x) for x in ("100", "64K", "1.5 MB", "330G")] == [100, 65536, 1572864, 330 << 30]
    for bad in ("", "x", "4y"):
        with pytest.raises(ValueError):
            parse_duration(bad)
        with pytest.raises(ValueError):
            parse_bytes(bad + "?")
