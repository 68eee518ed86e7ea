"""Tiled moments and the fits on them, at the full dimension, against dense algebra."""

from __future__ import annotations

import numpy as np
import pytest

from quorumlens.functions import moments as MO
from quorumlens.operators import regression as R


def rows_of(rng, n, dim, regions):
    vecs = lambda: [(int(r), float(rng.random()), rng.normal(size=dim).tolist()) for r in sorted(rng.choice(regions, 2, replace=False))]
    return [(str(rng.choice(["A2B", "B2A"])), float(rng.random()), vecs(), vecs()) for _ in range(n)]


@pytest.mark.parametrize("dim, n, regions, budget", [(256, 300, 2, 64 << 20), (5, 80, 3, 3000)])
def test_operators_at_full_dimension(spark, monkeypatch, dim, n, regions, budget):
    monkeypatch.setattr(MO, "FLUSH_BYTES", budget)
    rows = rows_of(np.random.default_rng(dim), n, dim, regions)
    vector = "array<struct<region: long, p: double, vector: array<double>>>"
    df = spark.createDataFrame(rows, f"pair string, w double, s_vecs {vector}, t_vecs {vector}").repartition(3)
    grid = spark.createDataFrame([(p, s, t) for p in ("A2B", "B2A") for s in range(regions + 1) for t in range(regions + 1)], "pair string, source long, target long")
    found = {(r.pair, r.source, r.target): r for r in R.fit_operators(MO.pair_moments(df, dim), dim, min_effective=1.0, grid=grid).collect()}
    assert len(found) == 2 * (regions + 1) ** 2
    cells, shared = {}, {}
    for pair, w, left, right in rows:
        for s, ps, x in left:
            for t, pt, y in right:
                for key, into in (((pair, s, t), cells), (pair, shared)):
                    into.setdefault(key, []).append((w * ps * pt, x, y))

    def solve(samples):
        w, x, y = (np.array([s[i] for s in samples]) for i in range(3))
        x = np.hstack([x, np.ones((len(x), 1))])
        reg = np.eye(dim + 1)
        reg[-1, -1] = 0
        return np.linalg.solve((x * w[:, None]).T @ x + reg, (x * w[:, None]).T @ y)

    for key, r in found.items():
        own = cells.get(key, [])
        want = solve(shared[key[0]]) if r.status == "low_support" else solve(own)
        assert r.n == len(own) and (r.status == "low_support") == (sum(s[0] for s in own) < 5 or len(own) < 2)
        assert np.allclose(np.reshape(r.a, (dim, dim)), want[:-1], atol=1e-6) and np.allclose(r.b, want[-1], atol=1e-6)
