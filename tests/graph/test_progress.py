"""Observed progress of replays, stops, versions by changes and by time."""

import numpy as np
import pytest

from tests.graph.test_updates import random_log, rows_of, sequential
from vertexloom.functions.statistics import trial_statistics
from vertexloom.plans import experiments
from vertexloom.sources import snapshots
from vertexloom.sources.snapshots import SnapshotStore
from vertexloom.streaming import progress, replay

LOG = "seq long, src long, dst long, weight double"


@pytest.mark.parametrize("policy", ["ignore", "overwrite"])
def test_versions_are_changes(spark, tmp_path, monkeypatch, policy):
    monkeypatch.setattr(snapshots, "WHOLE_EVERY", 3)
    log = random_log(51, 210)
    replay.write_segments(spark.createDataFrame(log, LOG), f"{tmp_path}/log", 1, batch=30)
    store = SnapshotStore(spark, f"{tmp_path}/versions", directed=False)
    found = replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress", on_duplicate=policy)
    assert store.versions() == list(range(1, 8)) and [r["updates"] for r in found.records] == [30] * 7
    for version in (1, 2, 3, 5, 6, 7):
        graph = store.load(version)
        now = sequential({}, log[: 30 * version], False, policy)
        assert rows_of(graph) == now
        assert {r.id for r in graph.vertices.collect()} == {v for _, a, b, w in log[: 30 * version] if w >= 0 for v in (a, b)}
    whole = sorted(p.parent.name for p in (tmp_path / "versions").glob("v=*/edges"))
    assert whole == ["v=000003", "v=000006"]  # the others are as large as their batches
    assert [r["inserts"] for r in found.records] == [sum(w >= 0 for *_, w in log[i : i + 30]) for i in range(0, 210, 30)]


def test_a_stopped_replay_keeps_its_records(spark, tmp_path, monkeypatch):
    log = random_log(52, 200)
    replay.write_segments(spark.createDataFrame(log, LOG), f"{tmp_path}/log", 40)
    store = SnapshotStore(spark, f"{tmp_path}/versions", directed=False)
    early = replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress", timeout=6)
    assert early.timed_out and len(early.records) < 40 and len(store.versions()) < 40
    assert sum(r["updates"] for r in early.records) == 5 * len(early.records)
    done = len(store.versions())
    if done:
        assert rows_of(store.load()) == sequential({}, log[: 5 * done], False, "ignore")
    monkeypatch.setattr(replay, "await_end", lambda query, timeout: bool(query.stop()) or True)
    none = experiments.aging(spark.createDataFrame(log, LOG), spark.createDataFrame([], "id long"), f"{tmp_path}/other", 5)
    assert none[1].timed_out and none[0].num_edges() <= len(log)


def test_stopped_replays_go_on(spark, tmp_path):
    log = random_log(53, 60)
    replay.write_segments(spark.createDataFrame(log, LOG), f"{tmp_path}/log", 6)
    store = SnapshotStore(spark, f"{tmp_path}/versions", directed=False)
    first = replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress", timeout=3)
    later = replay.replay(spark, f"{tmp_path}/log", store, f"{tmp_path}/progress")
    assert not later.timed_out and rows_of(store.load()) == sequential({}, log, False, "ignore")
    versions = [r["version"] for r in first.records + later.records]
    assert versions == sorted(set(versions)) and set(versions) <= set(range(1, 7))


RECORDS = [
    {"version": 1, "updates": 10, "inserts": 8, "deletes": 2, "microseconds": 400_000, "ended": 400_000},
    {"version": 2, "updates": 20, "inserts": 20, "deletes": 0, "microseconds": 900_000, "ended": 1_300_000},
    {"version": 3, "updates": 30, "inserts": 0, "deletes": 30, "microseconds": 2_000_000, "ended": 3_300_000},
]


def test_tables_of_progress(spark):
    assert [r["updates"] for r in progress.by_second(RECORDS)] == [10, 30, 30, 60]
    passed = progress.at_multiples(RECORDS, 20, 0.5)
    assert [(r["multiple"], r["updates"], r["microseconds"]) for r in passed] == [(0.5, 10, 400_000), (1, 30, 1_300_000), (1.5, 30, 1_300_000), (2, 60, 3_300_000), (2.5, 60, 3_300_000), (3, 60, 3_300_000)]
    assert progress.at_multiples(RECORDS, 0) == [] and progress.by_second([]) == []
    with pytest.raises(ValueError):
        progress.at_multiples(RECORDS, 20, 0)
    found = {r.kind: r for r in progress.latencies(spark, RECORDS).collect()}
    expanded = [(k, r["microseconds"]) for r in RECORDS for k, n in (("insert", r["inserts"]), ("delete", r["deletes"]), ("all", r["updates"])) for _ in range(n)]
    plain = {r.kind: r for r in trial_statistics(spark.createDataFrame(expanded, "kind string, x long"), ["kind"], "x").collect()}
    assert found == plain and found["insert"].n == 28 and found["all"].p99 == 2_000_000
    assert found["all"].mean == int(np.mean([x for k, x in expanded if k == "all"]))


def test_versions_by_time_while_updates_run(spark, tmp_path):
    log = random_log(54, 120)
    gone = spark.createDataFrame([(3,), (9,)], "id long")
    graph, replayed, versions = experiments.aging_stream(spark.createDataFrame(log, LOG), gone, str(tmp_path), 2, build_every=0.2, files=4)
    expected = {k: w for k, w in sequential({}, log, False, "ignore").items() if not {3, 9} & set(k)}
    assert rows_of(graph) == expected and len(versions) > 2
    assert sum(r["updates"] for r in replayed.records) == len(log) and not replayed.timed_out
    assert sum(r["deletes"] for r in replayed.records) == sum(w < 0 for *_, w in log)
