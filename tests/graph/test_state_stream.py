"""Keyed state of an update stream: equal to batches, across restarts, with operations that wait."""

import time

from tests.graph.test_outcomes import LOG, one_by_one, waiting
from tests.graph.test_updates import random_log
from vertexloom.streaming import state


def edges(told):
    return {(r.src, r.dst): r.weight for r in state.edges_of(told).collect()}


def test_outcomes_and_edges_over_a_restart(spark, tmp_path):
    log = random_log(41, 160)
    feed, out, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "out", "progress"))
    frame = spark.createDataFrame(log, LOG)
    state.write_feed(frame.where("seq < 90"), feed, 2, files=2)
    told = state.run_outcomes(spark, feed, out, checkpoint, files=1)
    expected, now = one_by_one({}, set(), log[:90], False, "ignore", "make")
    assert {r.seq: r.accepted for r in told.collect()} == expected and edges(told) == now
    before = {f for f in (tmp_path / "out").iterdir() if f.suffix == ".parquet"}
    state.write_feed(frame.where("seq >= 90"), feed, 2, files=2)
    told = state.run_outcomes(spark, feed, out, checkpoint, files=4)  # another query on the same checkpoint
    expected, now = one_by_one({}, set(), log, False, "ignore", "make")
    rows = told.collect()
    assert len(rows) == len(log) and {r.seq: r.accepted for r in rows} == expected and edges(told) == now
    assert before < {f for f in (tmp_path / "out").iterdir() if f.suffix == ".parquet"}  # what was written stays


def test_overwriting(spark, tmp_path):
    log = random_log(42, 80)
    state.write_feed(spark.createDataFrame(log, LOG), f"{tmp_path}/feed", 2)
    told = state.run_outcomes(spark, f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/progress", on_duplicate="overwrite", files=2)
    expected, now = one_by_one({}, set(), log, False, "overwrite", "make")
    assert {r.seq: r.accepted for r in told.collect()} == expected and edges(told) == now


def test_operations_wait_and_are_given_up(spark, tmp_path):
    log = [(0, 1, 2, -1.0), (1, 1, 2, 5.0), (2, 1, 2, 6.0), (3, 3, 4, -1.0), (4, 5, 6, 1.0), (5, 6, 5, 2.0)]
    feed, out, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "out", "progress"))
    state.write_feed(spark.createDataFrame(log[:1], LOG), feed, 1)
    assert state.run_outcomes(spark, feed, out, checkpoint, wait=600).count() == 0
    state.write_feed(spark.createDataFrame(log[1:], LOG), feed, 1)
    told = {r.seq: (r.accepted, r.at, r.turn) for r in state.run_outcomes(spark, feed, out, checkpoint, wait=1).collect()}
    assert told == {1: (True, 1, 0), 0: (True, 1, 1), 2: (True, 2, 0), 4: (True, 4, 0)}
    expected, now = waiting({}, log, False)
    assert {s for s, ok in expected.items() if ok} == set(told)
    time.sleep(1.5)  # timers of the two that still wait
    state.write_feed(spark.createDataFrame([(6, 7, 8, 3.0)], LOG), feed, 1)
    told = state.run_outcomes(spark, feed, out, checkpoint, wait=1)
    by = {r.seq: r.accepted for r in told.collect()}
    assert {s: by[s] for s in (3, 5, 6)} == {3: False, 5: False, 6: True}
    assert edges(told) == now | {(7, 8): 3.0}


def test_nothing_arrives(spark, tmp_path):
    state.write_feed(spark.createDataFrame([], LOG), f"{tmp_path}/feed", 1)
    assert state.run_outcomes(spark, f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/progress").count() == 0
