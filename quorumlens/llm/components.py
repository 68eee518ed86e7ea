"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges (a, b); a component is named by one of its nodes.

    In each round a node takes the neighbour, or itself, that comes first in an order drawn anew for the round, and nodes
    with the same choice become one.  The least neighbour is an aggregate that combines before the shuffle, so a node with
    a third of all edges is no hot key.  The expected number of rounds is logarithmic.
    """
    live = stored(edges.filter("a <> b").select("a", "b").distinct())
    names = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    turn = 0
    while not live.isEmpty():
        turn += 1
        # The first order is that of the ids, so that stars around their least node need one round.
        order = lambda c: F.struct((c if turn == 1 else F.xxhash64(F.lit(turn), c)).alias("h"), c.alias("id"))
        both = live.union(live.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("other"))
        choice = least.select("a", F.least(F.col("other"), order(F.col("a"))).getField("id").alias("to"))
        # Two steps at once: the choice of the choice.
        jump = stored(choice.alias("x").join(choice.alias("y"), F.col("x.to") == F.col("y.a"), "left").select(
            F.col("x.a").alias("a"), F.coalesce("y.to", "x.to").alias("to")))
        names = names.join(jump.select(F.col("a").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
        one = live.join(jump, "a").select(F.col("to").alias("a"), "b")
        two = one.join(jump.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b").select("a", F.col("to_b").alias("b"))
        live = stored(two.filter("a <> b").distinct())
    return names
