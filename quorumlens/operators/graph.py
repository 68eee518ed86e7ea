"""Regions of the label graph: communities, spectral regions, choice of a solution, spanning trees.

Edges are (src, dst, w) with src < dst and assignments (label, c); labels are of any type.  Rounds are joins and aggregates over
edges and labels; each ends in a checkpoint.  Communities are in `louvain`, eigenvectors and k-means in `spectral`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionary import decoded, dictionary, encoded
from ..functions.lineage import written
from .louvain import louvain
from .spectral import spectral_regions

# Weights of the choice score and the resolutions and sizes scanned.
MODULARITY_WEIGHT, SINGLETON_WEIGHT, COARSE_STEP, OVERSIZE_FROM, OVERSIZE_WEIGHT = 0.5, 2.0, 0.25, 0.35, 2.0
RESOLUTIONS = [0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6]
SPECTRAL_SIZES = list(range(6, 17))


def both_ways(edges: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u"))))
    return edges.select(pair.alias("e"), "w").select("e.v", "e.u", "w")


def modularity(edges: DataFrame, assignment: DataFrame, resolution: Column | float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over regions of intra / m - resolution * (degree / 2m)^2; null without edges.

    `keys` name the solutions when the assignment holds several.
    """
    keys = list(keys)
    gamma = resolution if isinstance(resolution, Column) else F.lit(float(resolution))
    total = edges.agg(F.sum("w").alias("_m"))
    a = assignment.select(*keys, F.col("label").alias("src"), F.col("c").alias("_cs"))
    b = assignment.select(*keys, F.col("label").alias("dst"), F.col("c").alias("_cd"))
    placed = edges.join(a, "src").join(b, ["dst", *keys])
    ends = F.explode(F.array(F.col("_cs"), F.col("_cd"))).alias("c")
    per = placed.select(*keys, "w", (F.col("_cs") == F.col("_cd")).alias("_in"), ends).groupBy(*keys, "c").agg(
        (F.sum(F.when(F.col("_in"), F.col("w")).otherwise(0.0)) / 2).alias("_l"), F.sum("w").alias("_d"))
    j = per.crossJoin(F.broadcast(total))  # one-row side
    part = F.col("_l") / F.col("_m") - gamma * F.pow(F.col("_d") / (2 * F.col("_m")), F.lit(2.0))
    return j.groupBy(*keys).agg(F.sum(part).alias("modularity"))


def communities(edges: DataFrame, labels: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """(resolution, label, c) by multilevel moves without random choices; labels of any type, c is an id."""
    ids = dictionary((labels, "label"), (edges, "src"), (edges, "dst"))
    found = louvain(encoded(edges.select("src", "dst", "w"), ids, ["src", "dst"]), ids.select(F.col("id").alias("v")), resolutions)
    return decoded(found.select("resolution", F.col("v").alias("label"), "c"), ids, ["label"])


def move_gains(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(resolution, label, gain): the most that the modularity times m rises if one label moves to a neighbour's community or to one of its own."""
    two_m = edges.agg((2 * F.sum("w")).alias("_mm"))
    both = both_ways(edges)
    degree = both.groupBy("v").agg(F.sum("w").alias("k"))
    at = lambda n, c: assignment.select("resolution", F.col("label").alias(n), F.col("c").alias(c))
    size = at("v", "c").join(degree, "v").groupBy("resolution", "c").agg(F.sum("k").alias("d"))
    links = both.join(at("u", "c"), "u").groupBy("resolution", "v", "c").agg(F.sum("w").alias("kc"))
    stay = at("v", "c").join(degree.select("v"), "v").select("resolution", "v", "c", F.lit(0.0).alias("kc"))
    options = links.unionByName(stay).groupBy("resolution", "v", "c").agg(F.sum("kc").alias("kc"))
    o = options.join(size, ["resolution", "c"]).join(degree, "v").join(at("v", "_own"), ["resolution", "v"]).crossJoin(F.broadcast(two_m))  # one-row side
    mine = F.col("c") == F.col("_own")
    value = F.col("kc") - F.col("resolution") * F.col("k") * (F.col("d") - F.when(mine, F.col("k")).otherwise(0.0)) / F.col("_mm")
    best = o.groupBy("resolution", F.col("v").alias("label")).agg(F.max(value).alias("_best"), F.max(F.when(mine, value)).alias("_stay"))
    return best.select("resolution", "label", (F.greatest("_best", F.lit(0.0)) - F.col("_stay")).alias("gain"))


def named(assignment: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`cluster_NN` by (size desc, first member).  One row per label and solution."""
    keys = list(keys)
    size = assignment.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")  # regions of one solution
    ids = size.withColumn("region", F.format_string("cluster_%02d", F.row_number().over(w) - 1))
    return assignment.join(ids.select(*keys, "c", "region"), [*keys, "c"]).select(*keys, "label", "region")


def community_scan(edges: DataFrame, labels: DataFrame, resolutions: Sequence[float] = tuple(RESOLUTIONS)) -> DataFrame:
    """One named assignment per resolution (solution, resolution, label, region)."""
    found = named(written(communities(edges, labels, resolutions)), ["resolution"])
    return found.select(F.concat(F.lit("resolution="), F.col("resolution").cast("string")).alias("solution"), "resolution", "label", "region")


def spectral_scan(affinity: DataFrame, sizes: Sequence[int] = tuple(SPECTRAL_SIZES), restarts: int = 8, seed: int = 13) -> DataFrame:
    """K-means on the row-normalised leading eigenvectors, best of several seeded starts, for every k up to the number of labels."""
    found = named(written(spectral_regions(affinity, sizes, restarts, seed).select("k", "label", "c")), ["k"])
    return found.select(F.concat(F.lit("K="), F.col("k").cast("string")).alias("solution"), F.lit(1.0).alias("resolution"), "label", "region")


def solution_summary(edges: DataFrame, solutions: DataFrame) -> DataFrame:
    """Region, singleton, largest and smallest counts and modularity per solution."""
    size = solutions.groupBy("solution", "resolution", "region").agg(F.count(F.lit(1)).alias("n"))
    agg = size.groupBy("solution", "resolution").agg(
        F.count(F.lit(1)).alias("regions"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    q = modularity(edges, solutions.withColumnRenamed("region", "c"), F.col("resolution"), ["solution", "resolution"])
    return agg.join(q, ["solution", "resolution"], "left")


def choose_solutions(summary: DataFrame, labels: int, top: int = 3) -> DataFrame:
    """The best solutions by modularity minus penalties for singletons, granularity, coarseness and size.

    If the summary has a column method, solutions of method "community" are the pool when there are any, the others only without them.
    """
    n = max(labels, 1)
    target = min(12, max(6, round(n**0.5)))
    single, share = F.col("singletons") / n, F.col("largest") / n
    score = (
        MODULARITY_WEIGHT * F.coalesce("modularity", F.lit(0.0)) - SINGLETON_WEIGHT * single - F.abs(F.col("regions") - target) / target
        - F.greatest(F.lit(0), 5 - F.col("regions")) * COARSE_STEP - F.greatest(F.lit(0.0), share - OVERSIZE_FROM) * OVERSIZE_WEIGHT)
    s = summary.withColumn("score", score)
    if "method" in summary.columns:
        found = summary.agg(F.coalesce(F.max(F.col("method") == "community"), F.lit(False)).alias("_any"))
        s = s.crossJoin(F.broadcast(found)).filter(~F.col("_any") | (F.col("method") == "community")).drop("_any")  # one-row side
    return s.orderBy(F.desc(F.round("score", 12)), F.asc("singletons"), F.asc("regions"), "solution").limit(top)


def spanning_trees(affinity: DataFrame, assignment: DataFrame) -> DataFrame:
    """A maximum spanning tree inside every region (src < dst, w, region), by Boruvka rounds.

    Every component takes its heaviest outgoing edge under one total order of edges (weight, then labels), so chosen
    edges never close a cycle; components are then contracted by pointer jumping.
    """
    a = assignment.select(F.col("label").alias("src"), F.col("region").alias("region"))
    b = assignment.select(F.col("label").alias("dst"), F.col("region").alias("_r"))
    e = written(affinity.filter("src < dst").join(a, "src").join(b, "dst").filter("region = _r").select("region", "src", "dst", "w"))
    comp = written(assignment.select("label", F.col("label").alias("c")))
    tree = None
    while True:
        outgoing = e.join(comp.select(F.col("label").alias("src"), F.col("c").alias("cs")), "src").join(
            comp.select(F.col("label").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs <> cd")
        sides = F.explode(F.array(F.struct(F.col("cs").alias("c"), F.col("cd").alias("o")), F.struct(F.col("cd").alias("c"), F.col("cs").alias("o")))).alias("s")
        flat = outgoing.select("region", "src", "dst", "w", sides).select("region", "src", "dst", "w", "s.c", "s.o")
        best = written(flat.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("n"), "src", "dst", "region", "o")).alias("b")).select(
            "c", "b.o", "b.src", "b.dst", "b.region", (-F.col("b.n")).alias("w")))
        if best.isEmpty():
            break
        chosen = best.select("region", "src", "dst", "w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        back = best.select(F.col("c").alias("o"), F.col("o").alias("_back"))
        parent = written(best.join(back, "o", "left").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p")))
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = written(parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("_m")))
            moving = not jumped.filter("_m").isEmpty()
            parent = jumped.select("c", "p")
            if not moving:
                break
        comp = written(comp.join(parent, "c", "left").select("label", F.coalesce("p", "c").alias("c")))
    return tree if tree is not None else e.limit(0)
