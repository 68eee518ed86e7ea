"""Regions of small graphs with a known answer."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quorumlens.operators import graph as G
from quorumlens.operators import louvain, spectral


def test_two_cliques_are_two_communities(spark):
    e = [(a, b, 1.0) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4, 0.1)]
    edges = spark.createDataFrame(e, "src long, dst long, w double")
    labels = spark.createDataFrame([(i,) for i in range(9)], "label long")
    got = G.named(G.communities(edges, labels, [1.0]).drop("resolution")).collect()
    region = {r.label: r.region for r in got}
    assert {region[i] for i in range(4)} == {"cluster_00"} and {region[i] for i in range(4, 8)} == {"cluster_01"} and region[8] == "cluster_02"
    q = G.modularity(edges, spark.createDataFrame([(i, i // 4) for i in range(8)], "label long, c long")).first().modularity
    m = 12.1
    assert abs(q - sum(6 / m - ((12.1) / (2 * m)) ** 2 for _ in range(2))) < 1e-9


def test_spanning_tree_has_the_largest_weight(spark):
    rnd = random.Random(8)
    e = [(a, b, rnd.random()) for a in range(12) for b in range(a + 1, 12)]
    aff = spark.createDataFrame(e, "src long, dst long, w double")
    region = {i: i % 2 for i in range(12)}
    got = G.spanning_trees(aff, spark.createDataFrame(list(region.items()), "label long, region long")).collect()
    want, parent = [], list(range(12))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted(e, key=lambda t: -t[2]):
        if region[a] == region[b] and root(a) != root(b):
            parent[root(a)] = root(b)
            want.append((a, b))
    assert sorted((r.src, r.dst) for r in got) == sorted(want)


def planted(groups, size, inside, outside, seed):
    """Edges (a, b, w), a < b, of a graph with planted groups; labels are texts."""
    rnd, e = random.Random(seed), {}
    n = groups * size
    for a in range(n):
        for _ in range(inside):
            b = a // size * size + rnd.randrange(size)
            e[min(a, b), max(a, b)] = 0.5 + rnd.random()
        for _ in range(outside):
            b = rnd.randrange(n)
            e[min(a, b), max(a, b)] = 0.1 * rnd.random()
    return [(f"v{a:05d}", f"v{b:05d}", w) for (a, b), w in e.items() if a != b], n


def test_communities_of_many_blocks_gain_by_no_move(spark, monkeypatch):
    monkeypatch.setattr(louvain, "VERTICES", 30)
    rows, n = planted(4, 15, 5, 1, 5)
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    labels = spark.createDataFrame([(f"v{i:05d}",) for i in range(n)] + [("zz alone",)], "label string")
    found = G.communities(edges, labels, [1.0]).cache()
    got = {(r.resolution, r.label): r.c for r in found.collect()}
    assert len(got) == found.count() == n + 1
    assert G.move_gains(edges, found).filter("gain > 1e-9").count() == 0
    for r in (1.0,):
        q = G.modularity(edges, found.filter(F.col("resolution") == r), r).first()[0]
        m, degree, part, inside = sum(w for *_, w in rows), {}, {}, 0.0
        for a, b, w in rows:
            for v in (a, b):
                degree[v] = degree.get(v, 0.0) + w
            inside += w * (got[r, a] == got[r, b])
        for v, d in degree.items():
            part[got[r, v]] = part.get(got[r, v], 0.0) + d
        assert abs(q - (inside / m - r * sum(d * d for d in part.values()) / (4 * m * m))) < 1e-9
        assert len({got[r, f"v{i:05d}"] for i in range(n)}) == 4


def test_eigenvectors_of_three_blocks(spark):
    rows, n = planted(3, 700, 12, 1, 7)
    both = rows + [(b, a, w) for a, b, w in rows]
    affinity = spark.createDataFrame(both, "src string, dst string, w double")
    found, values = spectral.eigenvectors(affinity, 3)
    a = np.zeros((n, n))
    for x, y, w in both:
        a[int(x[1:]), int(y[1:])] = w
    d = a.sum(axis=1)
    whole = a / np.sqrt(np.outer(d, d))
    x = np.array([r.x for r in found.orderBy("label").collect()])
    assert x.shape == (n, 3) and np.allclose(values, np.linalg.eigvalsh(whole)[::-1][:3], atol=1e-9)
    assert np.abs(whole @ x - x * values).max() < 1e-6 and np.allclose(x.T @ x, np.eye(3), atol=1e-8)
