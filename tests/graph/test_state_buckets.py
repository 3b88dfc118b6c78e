"""State by buckets of edges: as many keys as buckets, however many edges there are."""

from tests.graph.test_outcomes import LOG, one_by_one
from tests.graph.test_updates import random_log
from vertexloom.streaming import state


def test_many_edges_in_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 3)
    log = random_log(43, 200) + [(200 + i, i, 100 + i, 0.0 if i % 2 else -1.0) for i in range(150)] + [(350 + i, 100 + i, i, -1.0) for i in range(150)]
    state.write_feed(spark.createDataFrame(log, LOG), f"{tmp_path}/feed", 3, files=2)
    told = state.run_outcomes(spark, f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/progress", files=2)
    expected, now = one_by_one({}, set(), log, False, "ignore", "make")
    rows = told.collect()
    assert len(rows) == len(log) and {r.seq: r.accepted for r in rows} == expected
    assert {(r.src, r.dst): r.weight for r in state.edges_of(told).collect()} == now
    keys = spark.read.format("statestore").option("stateVarName", "edges").load(f"{tmp_path}/progress")
    assert 0 < keys.count() <= 3
