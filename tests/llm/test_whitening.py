"""Whitening against numpy, and exact deviations against whole numbers."""

import numpy as np

from vertexloom.llm import op13_whitening as op13

SCHEMA = "vec_id long, embedding array<float>, row string, x long, w string, fits long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", 1, None, 2) for i, v in rows], SCHEMA)


def slow(rows, most=16):
    fine = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(x) for _, x in fine), default=0)
    fine = [(i, x + [1_000_000] * (dim - len(x))) for i, x in fine]
    fit = sorted({tuple(x) for _, x in fine})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit]).reshape(n, dim)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    mine = np.array([[(n * a - b) / n for a, b in zip(x, s)] for _, x in fine]) @ (vectors[:, :k] / np.sqrt(values[:k]))
    return n, [(i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in fine], mine, values[:k] / values.sum()


def check(spark, rows):
    out = op13.whiten(frame(spark, rows), "vec_id", "embedding")
    n, deviations, mine, explained = slow(rows)
    got = {}
    for r in out.collect():
        assert (r.n, abs(r.explained / explained[r.component - 1] - 1) < 1e-9, r.identity_error < 1e-9) == (n, True, True)
        got.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
    k = mine.shape[1]
    assert sum(map(len, got.values())) == len(deviations) * k
    signs = []
    for c in range(k):
        own = {}
        for (i, d), w in zip(deviations, mine[:, c]):
            own.setdefault((i, d, c + 1), []).append(w)
        flat = lambda s: np.array([w for key in sorted(own, key=repr) for w in sorted(s * x for x in own[key])])  # noqa: E731,B023
        have = np.array([w for key in sorted(own, key=repr) for w in sorted(got[key])])
        signs.append(any(np.allclose(have, flat(s), rtol=1e-7, atol=1e-9) for s in (1, -1)))
    assert all(signs)
    return out


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 3, 20)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None)]
    out = check(spark, rows)
    assert out.dtypes == [tuple(c.split()) for c in op13.OUTPUT.replace("long", "bigint").split(", ")]
    monkeypatch.setattr(op13, "ROWS", 16)
    monkeypatch.setattr(op13, "MIDDLE", 2)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.5]), (2, [2.0, 0.25]), (2, [2.0, 0.25]), (3, [0.5]), (4, []), (5, None), (6, [1.0, None]), (7, [float("nan"), 0.0]), (8, [float("-inf"), 0.0]), (9, [3.0, 3.0])]
    check(spark, rows)
    low = op13.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0, 8.0])]), "vec_id", "embedding").collect()
    assert {r.component for r in low} == {1} and len(low) == 3
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert op13.whiten(frame(spark, rows), "vec_id", "embedding").count() == 0
    huge = op13.whiten(frame(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])]), "vec_id", "embedding").collect()
    assert [r.deviation for r in huge if r.vec_id != 3] == [None, None] and all(np.isfinite(r.whitened) for r in huge)
    # sums whose squares are just no longs, but for one row
    some = op13.whiten(frame(spark, [(1, [2.0**26]), (2, [0.0]), (3, [1.0])]), "vec_id", "embedding").collect()
    fit = [int(64 * 2**26) + 1_000_000, 1_000_000, 1_000_064]
    expected = [(3 * x - sum(fit)) ** 2 for x in fit]
    assert [r.deviation for r in sorted(some)] == [e if e < 1 << 63 else None for e in expected]


def test_whole_table(spark):
    from vertexloom.session import table

    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, path, "embeddings").select("vec_id", "embedding").collect()]
    out = op13.op13_whitening(spark, path).collect()
    n, deviations, mine, explained = slow(rows)
    assert len(out) == 16 * len(rows) and {(r.vec_id, r.deviation) for r in out} == set(deviations)
    place = {i: k for k, (i, _) in enumerate(deviations)}
    w = np.zeros_like(mine)
    for r in out:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert all(np.allclose(w[:, c], s * mine[:, c], rtol=1e-8, atol=1e-10) for c in range(16) for s in [np.sign(w[0, c] * mine[0, c])])
