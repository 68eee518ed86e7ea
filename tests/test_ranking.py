"""Ranks over ranges of the whole sort key, and projections of items that are partly outside the membership."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quorumlens.functions.dictionary import decoded, dictionary, encoded
from quorumlens.functions.ranking import range_positions
from quorumlens.operators import membership as mem


def test_ranks_with_half_of_all_values_equal(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "cold", None]), 0.0 if i % 2 else rnd.choice([None, rnd.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, id long").repartition(9)
    got = {r.id: (r.pos, r.n) for r in range_positions(df, ["k"], [F.desc("x"), "id"], "pos", "n").collect()}
    for key in ("hot", "cold", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0.0), r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]
    sizes = [r["count"] for r in df.repartitionByRange(8, F.desc("x"), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]  # equal values are cut by the ids after them


def test_dictionary_of_texts(spark):
    edges = spark.createDataFrame([("b", "a"), ("ä", "b"), (None, "a"), ("", "b")], "src string, dst string")
    ids = dictionary((edges, "src"), (edges, "dst"))
    assert {r.label: r.id for r in ids.collect()} == {"": 0, "a": 1, "b": 2, "ä": 3}
    coded = encoded(edges, ids, ["src", "dst"])
    assert sorted(map(tuple, coded.collect())) == [(0, 2), (2, 1), (3, 2)]
    assert sorted(map(tuple, decoded(coded, ids, ["src", "dst"]).collect())) == [("", "b"), ("b", "a"), ("ä", "b")]


def test_items_partly_outside_the_membership(spark):
    soft = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.7), ("b", 9, 0.3), ("c", 9, 1.0)], "item string, label long, p double")
    of = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.25), (2, 1, 0.75)], "label long, region long, m double")
    kept = {(r["item"], r.region): round(r.p, 9) for r in mem.project_complete(soft, of, ["item"]).collect()}
    assert kept == {("a", 0): 0.625, ("a", 1): 0.375}
    out = {r["item"]: (r.missing_labels, round(r.missing_mass, 9)) for r in mem.projection_rejects(soft, of, ["item"]).collect()}
    assert out == {"b": (1, 0.3), "c": (1, 1.0)}
