"""Exact search against brute force, and what pruning saves."""

import numpy as np

from vertexloom.llm import op12_exact_topk as op12

SCHEMA = "vec_id long, embedding array<float>, score string, block long, ids string"


def slow(rows, step=50, k=5):
    """Rows ``(id, vector)`` by brute force, in whole numbers; null ids last of their ties."""
    fine = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for q, a in fine:
        if q is None or q % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in fine if i != q)
        found += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k])]
    return sorted(found, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, None) for i, v in rows], SCHEMA)


def found(spark, rows, **options):
    df = frame(spark, rows)
    out = op12.top_k(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", **options)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def clustered(rng, n, dim, centres):
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)


def test_random_rows_in_many_blocks_and_tiles(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.125, (700, 20)).astype(np.float32))]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # copies tie
    expected = slow(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, block=7, tile_rows=90) == expected


def test_odd_rows(spark):
    one = [1.0, -0.5, 0.25]
    rows = [(0, one), (50, None), (100, [1.0, None, 2.0]), (150, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 0.0, 0.0]), (250, []), (300, [0.5]), (None, one), (7, one), (5, one), (9, [-1.0, 0.5, 0.3, 4.0]), (100, [0.1, 0.2, 0.3])]
    assert found(spark, rows) == slow(rows)
    assert found(spark, [(0, one)]) == [] and found(spark, []) == [] and found(spark, [(0, None)]) == []
    assert found(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    again = found(spark, [(0, one), (0, one), (3, one)])  # both rows of an id ask, neither finds the other
    assert [r[:3] for r in again] == [(0, 1, 3), (0, 1, 3)]
    large = found(spark, [(0, [3e38, 0.0]), (1, [3e38, 1.0]), (2, [-3e38, 1.0])])
    assert large == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_blocks_are_left_out(spark):
    rng = np.random.default_rng(5)
    rows = np.floor(256 * clustered(rng, 4000, 16, 40)).astype(float)
    rows = rows[np.lexsort([np.floor(rows[:, 0] >= 0), rows[:, 1] >= 0, rows[:, 2] >= 0, rows[:, 3] >= 0, rows[:, 4] >= 0])]
    ids = np.arange(len(rows))
    cuts = range(0, len(rows), 20)
    forward = [rows[i : i + 20] for i in cuts]
    low, high = np.array([f.min(axis=0) for f in forward]), np.array([f.max(axis=0) for f in forward])
    asked = rows[::100]
    best, scored = op12.search(ids[::100], asked, [ids[i : i + 20] for i in cuts], forward, low, high, 5)
    assert scored < 0.8 * len(asked) * len(forward)
    scores = asked @ rows.T
    scores[np.arange(len(asked)), ids[::100]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)[:, :5]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(scores, order, 1)).all()
