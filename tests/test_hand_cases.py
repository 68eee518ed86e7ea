"""Hand-computed cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quorumlens.functions import dist as D
from quorumlens.operators import membership as mem
from quorumlens.operators import quality as Q
from quorumlens.operators import regression as R
from quorumlens.operators import similarity as sim
from quorumlens.operators import softlabel as sl
from quorumlens.operators import transition as tr
from quorumlens.functions.moments import pair_moments


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_strict_votes(spark):
    v = spark.createDataFrame([("i", "a", 1), ("i", "b", 3), ("i", "a", 2)], "item string, label string, confidence int")
    inv = spark.createDataFrame([("a",), ("b",)], "label string")
    assert rows(sl.strict_distribution(v, inv, ["item"]), "label", "p") == [("a", 0.5), ("b", 0.5)]


def test_soft_label_skips_zero_confidence(spark):
    v = spark.createDataFrame([("i", "a", 2), ("i", "b", 1), ("i", "c", 0)], "item string, label string, confidence int")
    got = rows(sl.soft_labels(v, ["item"]), "label", "p")
    assert [g[0] for g in got] == ["a", "b"] and sum(g[1] for g in got) == pytest.approx(1)


def test_entropy_of_two_equal_labels(spark):
    v = spark.createDataFrame([("i", "b", 1), ("i", "a", 1)], "item string, label string, confidence int")
    r = sl.item_uncertainty(sl.soft_labels(v, ["item"]), ["item"]).first()
    assert (r.entropy_bits, r.effective_labels, r.top_label) == (1.0, 2.0, "a")


def test_constant_similarity_scales_to_zero(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.2), (1, 0, 0.2), (1, 1, 1.0)], "src long, dst long, w double")
    assert rows(sim.scaled(s), "src", "dst", "w") == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)]


def test_knn_union(spark):
    e = [("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.8)]
    s = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src string, dst string, w double")
    assert rows(sim.knn_graph(s, 1), "src", "dst") == [("a", "b"), ("b", "c")]


def test_membership_from_supports(spark):
    c = spark.createDataFrame([("x", "00", 3.0), ("x", "01", 1.0), ("y", "01", 2.0)], "label string, region string, support double")
    p = spark.createDataFrame([("x", "00"), ("y", "00"), ("z", "05")], "label string, primary string")
    got = {(r.label, r.region): r for r in mem.from_supports(c, p).collect()}
    assert got[("x", "00")].raw == 0.75 and got[("x", "00")].sharp > 0.75
    assert got[("y", "00")].raw == 0.5 and got[("y", "01")].sharp == 0.5
    assert got[("z", "05")].raw == 1.0 and got[("z", "05")].support is None


def test_projection_and_reliability(spark):
    q = spark.createDataFrame([("i", "a", 0.5), ("i", "b", 0.5)], "item string, label string, p double")
    m = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.25), ("b", 1, 0.75)], "label string, region long, m double")
    assert rows(mem.project(q, m, ["item"]), "region", "p") == [(0, 0.625), (1, 0.375)]
    r = spark.range(1).select(mem.reliability(F.lit(math.log(2)), 4, F.lit(2.5)).alias("r")).first().r
    assert r == pytest.approx(0.25)
    short = m.filter("label = 'a'")
    assert rows(mem.missing_mass(q, short), "label", "missing_mass") == [("b", 0.5)]
    with pytest.raises(Q.CheckFailed):
        Q.require_empty(mem.missing_mass(q, short), "labels without membership")


def test_local_vector_neighbours_start_with_self(spark):
    m = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 1.0), ("d", 1, 1.0)], "label string, region long, m double")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.5, 0.5])], "label string, v array<double>")
    got = {r.label: r for r in mem.local_vectors(m, v, None, 2, k=2).collect()}
    assert got["a"].neighbour_labels == ["a", "b"] and not got["a"].fallback
    assert got["d"].fallback and got["d"].local_vector == [0.5, 0.5]


def test_one_certain_transition(spark):
    turns = spark.createDataFrame([("train", 1, 0, "x", "A"), ("train", 1, 1, "y", "B")], "split string, conv_id long, turn long, item string, role string")
    from quorumlens.operators import sequence as seq

    pairs = seq.typed_pairs(turns, ["split", "conv_id"], "turn", ["item", "role"])
    space = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "item string, dist array<double>")
    counts = tr.soft_counts(tr.pair_ends(pairs, space), 2)
    assert [r.n for r in counts.filter("source = 0 AND target = 1").collect()] == [1.0]
    cond = tr.conditionals(counts, 2)
    assert cond.count() == 16
    assert all(abs(r.s - 1) < 1e-9 for r in cond.groupBy("pair", "source").agg(F.sum("cond").alias("s")).collect())


def test_ridge_recovers_a_line(spark):
    one = "array<struct<region:bigint,p:double,vector:array<double>>>"
    data = [("A2B", 1.0, [(0, 1.0, [float(x)])], [(0, 1.0, [2.0 * x + 1])]) for x in range(4)]
    pairs = spark.createDataFrame(data, f"pair string, w double, s_vecs {one}, t_vecs {one}")
    f = R.fit_operators(pair_moments(pairs, 1), 1, ridge=1e-8, min_effective=0, min_soft=0).first()
    assert f.a[0] == pytest.approx(2, abs=1e-4) and f.b[0] == pytest.approx(1, abs=1e-4) and f.mse < 1e-6


def test_divergence_bounds(spark):
    a, b, c = (F.array(*[F.lit(x) for x in v]) for v in ([1.0, 0.0], [0.0, 1.0], [0.3, 0.7]))
    r = spark.range(1).select(D.jensen_shannon(a, b, True).alias("m"), D.jensen_shannon(c, c, True).alias("z"),
                              (D.jensen_shannon(a, c) - D.jensen_shannon(c, a)).alias("s"),
                              D.overlap(F.array(F.lit(0.7), F.lit(0.3)), F.array(F.lit(0.2), F.lit(0.8))).alias("o")).first()
    assert r.m == pytest.approx(1) and r.z == pytest.approx(0) and r.s == pytest.approx(0) and r.o == pytest.approx(0.5)


def test_rollup_keeps_null_and_all_groups_apart(spark):
    from quorumlens.operators import softlabel as sl

    rows = [("train", None, "2_of_4"), ("all", "B", "4_of_4"), (None, "B", "4_of_4")]
    items = spark.createDataFrame([(*r, "p", 0.5, 0.5, 0.5, 2) for r in rows],
                                  "split string, role string, bucket string, pattern string, entropy double, majority_fraction double, top_p double, unique_labels long")
    got = [(r["split"], r["role"], r["n"], r["rate_2_of_4"]) for r in sl.agreement_rollup(items).collect()]
    assert ("all", "all", 3, 1 / 3) in got and ("all", "all", 1, 0.0) in got and (None, "all", 1, 0.0) in got
    assert ("train", "B", 0, 0.0) in got and len(got) == 12


def test_perplexity_without_tokens(spark):
    from quorumlens.operators import metrics

    rows = spark.createDataFrame([("a", 0.0, 0), ("b", 2.0, 2)], "g string, nll double, tokens long")
    got = {r["g"]: (r["loss"], r["perplexity"]) for r in metrics.perplexity(rows, ["g"], "nll", "tokens").collect()}
    assert got["a"] == (None, None) and got["b"][0] == 1.0


def test_poisson_resampling_is_centred(spark):
    from quorumlens.operators import judge

    units = spark.range(400).selectExpr("id", "cast(id as double) v", "1 AS one")
    rows = judge.resampled_sums(units, ["id"], ["v", "one"], 2000, 7).collect()
    mean = sum(r["one"] for r in rows) / len(rows)
    assert len(rows) == 2000 and abs(mean - 400) < 2 and 15 < (sum((r["one"] - mean) ** 2 for r in rows) / len(rows)) ** 0.5 < 25


def test_nested_metrics_at_any_depth(spark):
    from quorumlens.operators import tables

    rows = spark.createDataFrame([("r", '{"a":{"b":{"c":{"d":{"e":{"f":1.5}}}}},"name":"x","n":2}')], "run string, tree string")
    got = {(r["path"], r["value"], r["text"]) for r in tables.flatten_metrics(rows, ["run"], "tree").collect()}
    assert got == {("a.b.c.d.e.f", 1.5, None), ("name", None, "x"), ("n", 2.0, None)}


def test_unlabelled_conversations_are_exported(spark):
    from quorumlens.sources import sinks

    rows = spark.createDataFrame([("m1", "train", 1, 0, "A", None, 3), ("m1", "train", 2, 0, "A", "x", 3)],
                                 "annotator string, split string, conv_id long, turn int, role string, label string, confidence int")
    got = {r["conv_id"]: len(r["turn_annotations"]) for r in sinks.metadata_records(sinks.metadata_turns(rows)).collect()}
    assert got == {1: 0, 2: 1}
