"""Blocks of arcs: packed by tasks that never hold one whole, and not shuffled in a round."""

import random

from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.kernels import blocks


def test_large_blocks_are_dealt_and_rounds_leave_blocks_in_place(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_PARTS", 2)
    draw = random.Random(3)
    pairs = sorted({tuple(sorted(draw.sample(range(30), 2))) for _ in range(150)})
    graph = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"), False)
    held = blocks.ArcBlocks(graph, 16, 5)
    names = {r["logical"]: r["id"] for r in held.ids.collect()}
    rows = held.blocks.collect()
    assert len({(r.row, r.column, r.part) for r in rows}) == len(rows) and len({r.part & 1048575 for r in rows}) > 1
    found = []
    for r in rows:
        assert 0 < len(r.targets) <= 5
        for s, at, end in zip(r.sources, r.offsets, r.offsets[1:]):
            found += [(names[r.row * 16 + s], names[r.column * 16 + d]) for d in r.targets[at:end]]
    assert sorted(found) == sorted(pairs + [(b, a) for a, b in pairs])
    monkeypatch.setattr(blocks, "BROADCAST_VERTICES", held.n)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = held.vectors(held.ids.select("logical", F.lit(1.0).alias("value")))
        plan = lambda: held.sums(vectors)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan()
        inside = [y for r in held.sums(vectors).sort("range").collect() for y in r.ys]
        monkeypatch.setattr(blocks, "BROADCAST_VERTICES", held.n - 1)
        assert "SortMergeJoin" in plan()
        assert inside == [y for r in held.sums(vectors).sort("range").collect() for y in r.ys] and sum(inside) == 2 * len(pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
