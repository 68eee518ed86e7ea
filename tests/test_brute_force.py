"""Checks against plain Python on small inputs, hot keys included."""

from __future__ import annotations

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.functions import ranking
from quorumlens.functions.moments import pair_moments
from quorumlens.operators import judge as J
from quorumlens.operators import predict as P
from quorumlens.operators import regression as R
from quorumlens.operators import sample as A
from quorumlens.operators import sequence as seq
from quorumlens.operators import similarity as sim
from quorumlens.operators import textmetrics as TM


@pytest.fixture(scope="module")
def skewed():
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}", i, rnd.choice([0.0, rnd.random()])) for i in range(3000)]
    return data


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_positions_and_neighbours(spark, skewed, partitions):
    df = spark.createDataFrame(skewed, "k string, o long, v double").repartition(partitions)
    placed = ranking.positions(df, ["k"], ["o"], F.floor(F.col("o") / 64), "pos")
    groups: dict = {}
    for k, o, v in sorted(skewed, key=lambda r: r[1]):
        groups.setdefault(k, []).append(o)
    assert {(r.k, r.o): r.pos for r in placed.collect()} == {(k, o): i for k, os in groups.items() for i, o in enumerate(os)}
    near = ranking.ahead(placed, ["k"], "pos", ["o"], (1, 2), width=16)
    for r in near.collect():
        os = groups[r.k]
        for lag in (1, 2):
            want = os[r.pos + lag] if r.pos + lag < len(os) else None
            got = r[f"next{lag}"]
            assert (got.o if got else None) == want


def test_order_statistics(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, o long, v double")
    got = {r.k: r.median for r in ranking.median_of(df, ["k"], "v", 0.05).collect()}
    want: dict = {}
    for k, _, v in skewed:
        want.setdefault(k, []).append(v)
    assert got == pytest.approx({k: median(v) for k, v in want.items()})
    q = ranking.order_statistics(df, [], "v", [0.1, 0.9], 0.01).collect()
    assert {r.prob: r.q for r in q} == pytest.approx({p: float(np.percentile([v for *_, v in skewed], p * 100)) for p in (0.1, 0.9)})


def test_first_by_content_is_sequential(spark):
    rnd = random.Random(1)
    data = [(i, f"id{rnd.randrange(40)}", f"c{rnd.randrange(40)}") for i in range(120)]
    ids, contents, want = set(), set(), []
    for o, i, c in data:
        if i not in ids and c not in contents:
            ids.add(i), contents.add(c), want.append(o)
    df = spark.createDataFrame(data, "ord long, id string, content string")
    assert sorted(r.ord for r in seq.first_by_content(df, "id", ["content"], "ord").collect()) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_l(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 150)))
    data = [(i, text(), text()) for i in range(40)] + [(40, "a b c d e", "b x c e")]
    df = TM.with_rouge_l(spark.createDataFrame(data, "id long, h string, r string"), "h", "r")
    got = {r.id: r.rouge_l for r in df.collect()}
    for i, h, r in data:
        h, r = h.split(), r.split()
        n = lcs(h, r)
        want = 2 * (n / len(h)) * (n / len(r)) / (n / len(h) + n / len(r)) if n else 0.0
        assert got[i] == pytest.approx(want)


def vector_pairs(n=400, dim=3, seed=3):
    rng = np.random.default_rng(seed)
    side = lambda: [(int(r), float(rng.random()), rng.normal(size=dim).tolist()) for r in rng.choice(3, size=rng.integers(1, 4), replace=False)]
    return [("A2B" if i % 3 else "B2A", float(rng.random()), side(), side()) for i in range(n)]


def test_ridge_operators_against_numpy(spark):
    dim, data = 3, vector_pairs()
    one = "array<struct<region:bigint,p:double,vector:array<double>>>"
    df = spark.createDataFrame(data, f"pair string, w double, s_vecs {one}, t_vecs {one}").repartition(7)
    fits = {(r.pair, r.source, r.target): r for r in R.fit_operators(pair_moments(df, dim), dim).collect()}
    samples: dict = {}
    for pair, w, s, t in data:
        for i, p, x in s:
            for j, q, y in t:
                samples.setdefault((pair, i, j), []).append((w * p * q, x, y))
    assert set(fits) == set(samples)
    checked = 0
    for key, rows in samples.items():
        f = fits[key]
        w = np.array([r[0] for r in rows])
        x = np.hstack([np.array([r[1] for r in rows]), np.ones((len(rows), 1))])
        y = np.array([r[2] for r in rows])
        assert f.soft_support == pytest.approx(w.sum()) and f.n == len(rows)
        if f.backoff == "none":
            reg = np.eye(dim + 1) * f.ridge
            reg[-1, -1] = 0
            coef = np.linalg.solve((x * w[:, None]).T @ x + reg, (x * w[:, None]).T @ y)
            assert np.allclose(np.reshape(f.a, (dim, dim)), coef[:-1]) and np.allclose(f.b, coef[-1])
            checked += 1
        coef = np.vstack([np.reshape(f.a, (dim, dim)), np.reshape(f.b, (1, dim))])
        err = ((x @ coef - y) ** 2).sum(1)
        assert f.mse == pytest.approx(err.mean()) and f.weighted_mse == pytest.approx((w * err).sum() / w.sum())
    assert checked > 3


def test_ridge_classifier_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.7)
    y = rng.dirichlet(np.ones(3), size=60)
    x[7] = 0  # no tokens
    feats = spark.createDataFrame([(f"i{i}", [(int(b), float(x[i, b])) for b in range(5) if x[i, b] != 0]) for i in range(60)], "item string, f array<struct<bucket: long, x: double>>")
    gold = spark.createDataFrame([(f"i{i}", y[i].tolist()) for i in range(60)], "item string, gold array<double>")
    lists = feats.join(gold, "item")
    w = P.ridge_weights(P.ridge_moments(lists, "gold", 5, 3), 5, 3, [0.5])
    a = np.hstack([x, np.ones((60, 1))])
    reg = np.eye(6) * 0.5
    reg[-1, -1] = 0
    want = np.linalg.solve(a.T @ a + reg, a.T @ y)
    got = np.array(w.first().c)
    assert np.allclose(got, want)
    scores = {r.item: r.scores for r in P.ridge_scores(feats, w, 5, 3).collect()}
    assert all(np.allclose(scores[f"i{i}"], a[i] @ want) for i in range(60))


def test_nearest_examples_in_blocks(spark):
    rng = np.random.default_rng(6)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    q, s = unit(11), unit(50)
    q[3] = 0  # no tokens: all examples are alike, the first ones are taken
    rows = lambda m, k: spark.createDataFrame([(i, [(b, float(m[i, b])) for b in range(8) if m[i, b]]) for i in range(len(m))], f"{k} long, f array<struct<bucket: long, x: double>>")
    for block in (4, 100):
        got = sim.nearest_examples(rows(q, "q"), rows(s, "s").repartition(5), "q", "s", 3, "f", 8, block)
        best = {(r.q, r["rank"]): r.s for r in got.collect()}
        want = np.argsort(-(q @ s.T), axis=1, kind="stable")[:, :3]
        assert best == {(i, k + 1): int(want[i, k]) for i in range(11) for k in range(3)}


def test_sign_test(spark):
    from math import comb

    cases = [(7, 2), (0, 5), (30, 30), (100, 140), (0, 0)]
    df = spark.createDataFrame(cases, "w long, l long").select("w", "l", J.sign_test(F.col("w"), F.col("l")).alias("p"))
    for r in df.collect():
        n, k = r.w + r.l, min(r.w, r.l)
        want = None if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert (r.p is None) == (want is None) and (want is None or r.p == pytest.approx(want))


def test_diverse_sample_is_balanced_and_stable(spark):
    data = [(f"i{i}", i // 2, ["low", "high"][i % 2 == 0 and i % 3 == 0], i % 5, "AB"[i % 7 == 0]) for i in range(400)]
    draws = []
    for parts in (1, 9):
        df = spark.createDataFrame(data, "item string, conv_id long, stratum string, region long, role string").repartition(parts)
        draws.append(sorted(r.item for r in A.diverse_sample(df, "stratum", ["region", "role"], "conv_id", ["item"], 10, 1).collect()))
    assert draws[0] == draws[1]
    chosen = [d for d in data if d[0] in draws[0]]
    assert len({d[1] for d in chosen}) == len(chosen) == 20
    low = [d[3] for d in chosen if d[2] == "low"]
    assert max(low.count(r) for r in range(5)) - min(low.count(r) for r in range(5)) <= 1


def test_rater_rotation(spark):
    items = A.pairwise_items(spark.range(50).select(F.col("id").alias("context_id")), ["x", "y", "z"]).withColumn("item_id", F.concat_ws("/", "context_id", "comparison"))
    a = A.balance_sides(A.assign_raters(items, "context_id", ["x", "y", "z"], 10, 3), ["item_id", "rater"]).toPandas()
    assert (a.groupby("item_id").rater.nunique() == 3).all() and not a.duplicated(["context_id", "rater"]).any()
    assert (a.rater != a.held_out).all() and a.groupby("rater").size().pipe(lambda s: s.max() - s.min()) <= 9
    assert all(abs(2 * g.main_on_a.sum() - len(g)) <= 1 for _, g in a.groupby("comparison"))


def test_label_similarity_of_texts_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(sim, "GRAM_TILE", 7)
    monkeypatch.setattr(sim, "GRAM_BYTES", 2000)
    rng = np.random.default_rng(8)
    x = rng.random((50, 24)) * (rng.random((50, 24)) < 0.2)
    x[:, 5] = 0
    soft = spark.createDataFrame([(i, f"label {k:02d}", float(x[i, k])) for i in range(50) for k in range(24) if x[i, k]], "item long, label string, p double").repartition(4)
    got = {(r.src, r.dst): (r.raw, r.w) for r in sim.confusion_similarity(soft).collect()}
    raw, used = x.T @ x, [k for k in range(24) if k != 5]
    assert set(got) == {(f"label {a:02d}", f"label {b:02d}") for a in used for b in used}
    for a in used:
        for b in used:
            assert got[f"label {a:02d}", f"label {b:02d}"] == pytest.approx((raw[a, b], 1.0 if a == b else raw[a, b] / np.sqrt(raw[a, a] * raw[b, b])))
